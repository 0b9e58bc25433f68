"""Every licence rule on its published wording, wrapped as in licence files and source headers."""
import os
import sys
import textwrap

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tablelens.llm import license_rules  # noqa: E402

GPL = """This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD = """Copyright (c) 2020, A. Person

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
PUBLISHED = {
    "MIT": """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.""",
    "BSD-2-Clause": BSD,
    "BSD-3-Clause": BSD + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": GPL.format(":", ",", 3),
    "GPL-2.0-or-later": GPL.format(";", ";", 2),
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-only": "Licensed under the GNU General Public License, version 2.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}
#: one notice without its second paragraph, and the short notices
SHORT = {
    "GPL-3.0-or-later": GPL.format(":", ",", 3).split("\n\n")[0],
    "GPL-2.0-or-later": GPL.format(";", ";", 2).split("\n\n")[0],
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "This project is licensed under the MIT License.",
}


def wrapped(text, width, prefix, end="\n"):
    paragraphs = [textwrap.fill(p, width) for p in text.strip().split("\n\n")]
    return end.join((prefix + line).rstrip(" ") for line in "\n\n".join(paragraphs).split("\n"))


@pytest.mark.parametrize("prefix, end", [("", "\n"), (" * ", "\n"), ("# ", "\r\n"), ("// ", "\n"), (";; ", "\n")])
def test_published_texts(spark, prefix, end):
    cases = [(name, wrapped(text, width, prefix, end)) for texts in (PUBLISHED, SHORT) for name, text in texts.items()
             for width in (30, 72, 80, 10_000)]
    assert {n for n, _ in cases} == {n for n, _ in license_rules.RULES}
    got = license_rules.scan_licenses(spark.createDataFrame(cases, "name string, text string")).collect()
    for r in got:
        assert (r["licenses"], r["unmatched"]) == ([r["name"]], []), r["text"]


def test_lines_of_their_own_and_ends(spark):
    cases = {
        "A river ran\nReleased under the MIT License\nand on it went": ["MITref"],            # a line inside a paragraph
        "Note: released under the MIT License; enjoy": ["MITref"],
        "Not released\nunder the MIT License": [],                                            # part of a longer line
        "Licensed under the\n\nMIT License": [],                                              # a blank line ends a sentence
        "Licensed under the.\nMIT License": [],                                               # and so does a full stop
        "Licensed under the Apache License, Version 2.0\n(the \"License\")": ["Apache2ref"],   # the longest counts, once
        "Released under the MIT License\nAll rights reserved": ["MITref", "AllRights"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    assert {r["text"]: r["sentence_ids"] for r in license_rules.scan_licenses(df).collect()} == cases
