"""Conditional GET of targets on the executors: one row of response for each target, failures included."""

from __future__ import annotations

import http.client
import urllib.error
import urllib.request
import zlib

import pandas as pd
from pyspark.sql import DataFrame

AGENT = "webdelta/1.0"
RESPONSE = "tid string, url string, final_url string, status int, headers map<string,string>, html string, ms long"


def request(url: str, etag: str | None = None, modified: str | None = None, auth: str | None = None, agent: str = AGENT) -> urllib.request.Request:
    """auth: a whole Authorization header."""
    headers = {"User-Agent": agent, "Accept-Encoding": "gzip, deflate"}
    for k, v in (("If-None-Match", etag), ("If-Modified-Since", modified), ("Authorization", auth)):
        if v:
            headers[k] = v
    return urllib.request.Request(url, headers=headers)


def decoded(body: bytes, encoding: str | None, most: int) -> str | None:
    """The body's text, lossy UTF-8; null if it is larger than `most` bytes, packed or unpacked. A packed body that ends early is an error."""
    if len(body) > most:
        return None
    if encoding in ("gzip", "deflate"):
        stream = zlib.decompressobj(31 if encoding == "gzip" else 15)
        body = stream.decompress(body, most + 1)
        if len(body) <= most and not stream.eof:
            raise EOFError("the body ends early")
    return None if len(body) > most else body.decode("utf-8", "replace")


def fetched(targets: DataFrame, most: int = 5 << 20, timeout: float = 20.0, redirects: int = 3) -> DataFrame:
    """targets (tid, url; etag, modified, auth if there) to responses. Status 0 is a failure to connect or a body that cannot be unpacked, 599 a body over `most`."""
    names = [c for c in ("etag", "modified", "auth") if c in targets.columns]

    def run(batches):
        import time

        class Few(urllib.request.HTTPRedirectHandler):
            max_redirections = redirects

        opener = urllib.request.build_opener(Few())
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                began = time.monotonic()
                final, status, headers, html = r["url"], 0, {}, None
                try:
                    with opener.open(request(r["url"], *(r.get(n) for n in ("etag", "modified", "auth"))), timeout=timeout) as got:
                        final, status, headers = got.url, got.status, dict(got.headers.items())
                        html = decoded(got.read(most + 1), got.headers.get("Content-Encoding"), most)
                        status = status if html is not None else 599
                except urllib.error.HTTPError as e:
                    status, headers = e.code, dict(e.headers.items())
                except (OSError, ValueError, EOFError, zlib.error, http.client.HTTPException):
                    status = 0
                out.append((r["tid"], r["url"], final, status, headers, html, int((time.monotonic() - began) * 1000)))
            yield pd.DataFrame(out, columns=["tid", "url", "final_url", "status", "headers", "html", "ms"])

    return targets.select("tid", "url", *names).mapInPandas(run, RESPONSE)
