"""The registered index: every notice in any context, short forms, and the time that full texts take."""

import random
import time

import pytest

from textwarden.llm import license_scan

INDEX = license_scan.Index(license_scan.all_templates())
NOTICES = [(name, no, t) for name, texts in license_scan.all_templates().items() for no, t in enumerate(texts) if len(license_scan.words_of(t)) <= license_scan.NOTICE]
#: Words that stand in other templates, so that their grams compete with the notice's.
AROUND = ["the", "author", "copyright", "and", "no", "part", "License", "software", "of", "under", "a", "b", "xyzzy", "c", "this", "is"]


@pytest.mark.parametrize(("name", "no", "notice"), NOTICES)
def test_every_notice_in_any_context(name, no, notice):
    rnd = random.Random(no)
    for _ in range(40):
        before, after = (" ".join(rnd.choice(AROUND) for _ in range(rnd.randint(0, 5))) for _ in range(2))
        text = f"{before} {notice} {after}"
        start, end = len(before) + 1, len(before) + 1 + len(notice)
        found = [(m[0], m[3], m[4]) for m in INDEX.scan(text)]
        inside = [m for m in found if m[1] < end and m[2] > start]
        assert any(m[0] == name for m in inside), (text, found)


def test_short_notices_beside_known_words():
    for text in ("All rights reserved. the author", "copyright All rights reserved. and the", "a b All rights reserved. no part", "All rights reserved. License"):
        assert [m[0] for m in INDEX.scan(text)] == ["proprietary"]
    assert [m[0] for m in INDEX.scan("All rights reserved. (c) B. All rights reserved.")] == ["proprietary"] * 2
    assert INDEX.scan("all the rights reserved") == INDEX.scan("rights reserved") == []


def test_short_forms():
    want = {
        "Licensed under the GNU General Public License, version 3.": "GPL-3.0", "released under the mit licence": "MIT", "// SPDX-License-Identifier: MIT": "MIT", "it is GNU GPL v3 code": "GPL-3.0",
        "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "SPDX-License-Identifier: CC-BY-SA-4.0": "CC-BY-SA-4.0",
        "Licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
    }
    assert {t: [m[0] for m in INDEX.scan(t)] for t in want} == {t: [name] for t, name in want.items()}


@pytest.mark.parametrize("name", ["GPL-3.0", "LGPL-2.1", "MPL-2.0", "Apache-2.0"])
def test_full_text_takes_a_moment(name):
    text = license_scan.all_templates()[name][-1]
    began = time.process_time()
    found = INDEX.scan(f"Some words before. {text} And some after.")
    assert time.process_time() - began < 2
    longest = max(found, key=lambda m: m[4] - m[3])
    assert longest[0] == name and longest[2] > 0.95


def test_two_full_texts():
    a, b = (license_scan.all_templates()[n][-1] for n in ("Apache-2.0", "MPL-2.0"))
    found = [m for m in INDEX.scan(f"{a}\n between \n{b}\n{a}") if m[4] - m[3] > 2000]
    assert [m[0] for m in found] == ["Apache-2.0", "MPL-2.0", "Apache-2.0"]
