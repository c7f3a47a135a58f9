import textwrap

from webdelta.llm import licenses

MIT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.',
]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
]
GPL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY.",
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
MPL = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."]


def test_wrapped_texts(spark):
    cases = []
    for paragraphs, want in ((MIT, ["MIT"]), (APACHE, ["Apache-2.0"]), (GPL, ["GPL-3.0-or-later"]), (BSD, ["BSD-2-Clause"]), (MPL, ["MPL-2.0"])):
        for width in (40, 72, 80):
            wrapped = "\n\n".join(textwrap.fill(p, width) for p in paragraphs)
            cases.append((wrapped, want))
            cases.append((wrapped.replace("\n", "\r\n"), want))
            cases += [("\n".join((mark + line).rstrip() for line in wrapped.split("\n")), want) for mark in ("# ", "// ", " * ", "  ")]
            cases.append(("/*\n" + "\n".join(f" * {line}" for line in wrapped.split("\n")) + " */\nint x;", want))
    # A notice on a line of its own counts amid other lines; a blank line ends a sentence.
    cases += [("some code\n# Released under the MIT License\nmore", ["MIT"]), ("released under the\n\nmit license", []), ("not released under the mit license", [])]
    got = licenses.scanned(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(c[0], r["licenses"]) for c, r in zip(cases, got)] == cases
    assert got[0]["sentences"] == ["mit-grant", "mit-condition", "mit-warranty"]
    assert [r["sentences"] for r, c in zip(got, cases) if c[1] == ["Apache-2.0"]][0] == ["apache-notice", "apache-compliance", "apache-warranty"]
