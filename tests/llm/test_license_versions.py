import numpy as np
import pytest

from loomtext.llm.license_scan import INSIDE, NOTICES, Templates, hashed_words, license_scan, matches
from loomtext.llm.units import runs_of
from tests.llm.fixtures import SCHEMA

LINE = "This work is licensed under the GNU General Public License, version {}."
HEADER = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU{} General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
CASES = [
    (LINE.format(2), {"GPL-2.0"}),
    (LINE.format(3), {"GPL-3.0"}),
    (LINE.format(2) + " or " + LINE.format(3), {"GPL-2.0", "GPL-3.0"}),
    (HEADER.format("", 2), {"GPL-2.0"}),
    (HEADER.format("", 3), {"GPL-3.0"}),
    (HEADER.format(" Lesser", 3), {"LGPL-3.0"}),
    (HEADER.format(" Affero", 3), {"AGPL-3.0"}),
    (HEADER.format(" Lesser", "2.1").replace("program", "library"), {"LGPL-2.1"}),
    (HEADER.format(" Lesser", 3).replace("program", "library"), {"LGPL-3.0"}),
]


@pytest.mark.parametrize("pad", [0, 40_000])
def test_one_license_for_each_version(spark, pad):
    rows = [(i, " ".join(["some words of prose"] * (pad // 20 + i) + [t] + ["and more of it"] * (pad // 20)), "en", "s", 1) for i, (t, _) in enumerate(CASES)]
    found = [(r.doc_id, r.license) for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(found) == sorted((i, name) for i, (_, names) in enumerate(CASES) for name in names)


def test_windows_hold_their_templates_with_the_stated_similarity():
    templates = Templates()
    draw = np.random.default_rng(3)
    sizes = {i: (block, m) for (block, m), members in ((key, templates.bands[key][0][1]) for key in templates.bands) for own in members.values() for i in own}
    worst = 1.0
    for i, own in enumerate(templates.sets):
        n, (block, m) = len(own), sizes[i]
        span = block * m
        assert span >= n + block - 1  # wherever a passage starts, the window from the block before holds it
        need = -(-8 * n // 10)
        worst = min(worst, need / (span + n - need))
    assert worst >= 0.36 and (1 - worst) ** 32 < 1e-6
    text = NOTICES["BSD-3-Clause"][0].split()
    for _ in range(40):
        at = int(draw.integers(0, 400))
        raw = np.frombuffer(" ".join([*[f"w{k}" for k in range(at)], *text, *[f"v{k}" for k in range(300)]]).encode(), np.uint8)
        words = hashed_words(raw, *runs_of(INSIDE[raw], np.array([0, len(raw)])))
        assert {templates.names[t] for _, t, _, _ in matches(raw, words, templates)} == {"BSD-3-Clause"}


def test_cut_documents_give_the_same(spark):
    rows = [(i, " ".join([f"w{k % 977}" for k in range(3_000 + 37 * i)] + [t] + [f"v{k}" for k in range(5_000)]), "en", "s", 1) for i, t in enumerate([NOTICES["MIT"][-1], NOTICES["GPL-2.0"][1], "x" * 900_000 + " " + NOTICES["ISC"][0]])]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, cut = (sorted(map(tuple, license_scan(df, stretch=n).collect())) for n in (1 << 20, 700))
    assert whole == cut and [name for _, name, _ in whole] == ["MIT", "GPL-2.0", "ISC"]


def test_every_notice_gives_its_own_license(spark):
    own = [(name, text) for name, texts in NOTICES.items() for text in texts]
    rows = [(i, f"a b c {text} d e f", "en", "s", 1) for i, (_, text) in enumerate(own)]
    found = sorted((r.doc_id, r.license) for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(i, name) for i, (name, _) in enumerate(own)]
