import textwrap

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import licenses as L

PROSE = ["the quick brown fox jumps over the lazy dog", "a free version of this software guide is published", "work work work work this this this"]


def test_scan(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for i, (family, notices) in enumerate(L.TEMPLATES.items()):
        for j, notice in enumerate(notices):
            if not L.told_apart(family, L.plain(notice), L.plain(notice)):  # an opening that kin share
                continue
            d = 100 * i + j
            rows.append((d, "\n".join([PROSE[0], notice.upper() if j % 2 else notice, PROSE[1]]), "c"))
            want[d] = family
    for d, t in {9_000: None, 9_001: "", 9_002: "\n\n", 9_003: "All rights reserved.", 9_004: "\n".join(PROSE), 9_005: "This this this work is is the " * 2_000}.items():
        rows.append((d, t, "c"))
        want[d] = None
    rows += [(9_006, "Licensed under the Frobnicate Public License, version 3.", "c"), (None, "Released under the MIT License.", "c"), (0, rows[0][1], "c")]
    for k in range(200):
        rows.append((20_000 + k, " ".join(rng.choice(["".join(rng.choice(list("aeioust"), 4)) for _ in range(40)], 30)), "c"))
        want[20_000 + k] = None
    out = L.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id == 9_006:
            assert r.license == L.UNKNOWN and not r.confirmed
        else:
            assert r.license == ("MIT" if r.doc_id is None else want[r.doc_id]), r
            assert r.confirmed == (r.license is not None)
    by = {r.doc_id: r for r in out}
    assert by[0].n_paragraphs == 3 and by[0].n_licenses == 1 and by[9_002].n_paragraphs == 0


def test_varied_notices_are_recognised():
    """Of cut and altered notices, those that still name their version and kind are found; no other is taken for
    another family than its own."""
    model, rng = L.train(PROSE, seed=1), np.random.default_rng(9)
    right = total = 0
    for family, notices in L.TEMPLATES.items():
        for t in notices:
            for text in L.variations(t, rng, 10):
                found = L.scan_texts(pa.array([text]), model, 0.5)[0]
                # without its telling word a notice may be another licence's
                other = found[2] and found[0] != family and L.told_apart(found[0], L.plain(text), L.plain(text)) and not L.told_apart(family, L.plain(text), L.plain(text))
                assert found[0] == family or not found[2] or other, (family, text, found)
                own, needed = L._bigrams(text), L._telling(t) or L._bigrams(t)
                if not L.told_apart(family, L.plain(text), L.plain(text)):
                    continue
                if len(needed & own) == len(needed) if L._telling(t) else len(needed & own) >= 0.5 * len(needed):
                    right, total = right + (found[0] == family), total + 1
    assert total > 150 and right >= 0.9 * total


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
@pytest.mark.parametrize("width", [40, 72])
def test_wrapped_notices(mark, width):
    model = L.train(PROSE, seed=1)
    for family in ("MIT", "BSD-3-Clause", "GPL-3.0", "GPL-2.0", "LGPL-2.1", "AGPL-3.0", "Apache-2.0"):
        notice = " ".join([max(L.TEMPLATES[family], key=len), *L.CLAUSES.get(family, ([], []))[0]])
        lines = [mark + x for x in textwrap.wrap(notice, width)]
        head = ["/*"] * (mark == " * ") + [mark + "Copyright 2020 J. Doe", mark.rstrip()]
        for text in (head + lines + [mark.rstrip(), "import os"], PROSE * 200 + lines + PROSE * 200):
            found = L.scan_texts(pa.array(["\n".join(PROSE), "\n".join(text), None]), model, 0.8)
            assert found[1][0] == family and found[1][2] and found[1][4] >= 1, (family, found)
            assert found[0][0] is None and found[2] == (None, 0.0, False, 0, 0)


def test_versions_and_kin_are_told_apart():
    """Notices in one line and wrapped, and those of versions that no template has."""
    model, found, total = L.train(PROSE, seed=1), 0, 0
    for family, notices in L.TEMPLATES.items():
        for text in notices:
            for shown in (text, "\n".join(textwrap.wrap(text, 40))):
                name, _, sure, *_ = L.scan_texts(pa.array([shown]), model, 0.8)[0]
                assert name == family or not sure, (family, name, shown)
                if L.told_apart(family, L.plain(text), L.plain(text)):
                    found, total = found + (name == family and sure), total + 1
    assert found >= 0.9 * total
    for text in ("Released under the GNU General Public License version 1.", "Licensed under the Apache License, Version 1.1.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."):
        assert not L.scan_texts(pa.array([text]), model, 0.8)[0][2], text


BSD = "Copyright (c) 2020, J. Doe\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
BSD_2 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
BSD_ADS = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by J. Doe.\n\n"
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
KEEP = ", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'
X11 = "\n\nExcept as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software."
FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
NOTICES = {
    BSD + BSD_2 + BSD_END: "BSD-2-Clause", BSD + BSD_2 + BSD_NAMES + BSD_END: "BSD-3-Clause", BSD + BSD_2 + BSD_ADS + BSD_NAMES.replace("3.", "4.") + BSD_END: L.UNKNOWN, BSD: L.UNKNOWN,
    GRANT + KEEP + AS_IS: "MIT", GRANT + ".\n\n" + AS_IS: L.UNKNOWN, GRANT + KEEP + AS_IS + X11: L.UNKNOWN,
    FEE + ", provided that the above copyright notice and this permission notice appear in all copies.": "ISC", FEE + ".": L.UNKNOWN,
    "Released under the GNU Library General Public License version 2.": L.UNKNOWN, "This project is not licensed under the MIT license.": L.UNKNOWN, "Parts are no longer released under the Apache License, Version 2.0.": L.UNKNOWN,
    "Distributed under the GPL v3.": "GPL-3.0", "Licensed under the GPLv2.": "GPL-2.0", "Distributed under the LGPL v2.1.": "LGPL-2.1", "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "SPDX-License-Identifier: MIT-0": L.UNKNOWN,
    "/* SPDX-License-Identifier: Apache-2.0 */": "Apache-2.0", "This is free and unencumbered software released into the public domain.": "Unlicense", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
}


def test_real_notices_and_their_kin():
    """Each notice as it stands and with its paragraphs wrapped: the licence, or no confirmed one."""
    model = L.train(PROSE, seed=1)
    for notice, want in NOTICES.items():
        wrapped = "\n\n".join("\n".join(textwrap.wrap(p, 60)) for p in notice.split("\n\n"))
        for text in (notice, f"{PROSE[0]}\n{notice}\n{PROSE[1]}", wrapped):
            name, _, sure, *_ = L.scan_texts(pa.array([text]), model, 0.8)[0]
            assert (name, sure) == (want, True) if want != L.UNKNOWN else not sure, (want, name, text)


def test_against_brute_force():
    """Features, probabilities and template shares of single paragraphs, written out word by word."""
    import re as regex

    model = L.train(PROSE, seed=1)
    texts = [t for own in L.TEMPLATES.values() for t in own] + PROSE + L.NEGATIVES
    for text in texts:
        words = [regex.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) for w in text.split()]
        grams = {(w,) for w in words} | set(zip(words, words[1:], strict=False))
        column = {int(f): i for i, f in enumerate(model["kept"])}
        number = {g: int(L.features(pa.array([" ".join(g)]))[1][-1]) for g in grams}
        z = model["bias"] + sum((model["weights"][column[f]] for f in {*number.values()} if f in column), np.zeros(len(model["bias"])))
        p = np.exp(z / model["temperature"] - (z / model["temperature"]).max())
        p /= p.sum()
        like = p[:-1].sum() >= 0.5
        pairs = {number[g] for g in grams if len(g) == 2} or {number[g] for g in grams}
        shares = []
        for family in model["families"]:
            best = 0.0
            for t in L.TEMPLATES[family]:
                own = L._bigrams(t)
                best = max(best, len(own & pairs) / len(own) if L._telling(t) <= pairs else 0.0)
            shares.append(best)
        c = int(p[:-1].argmax())
        sure = like and p[c] >= model["threshold"] and shares[c] >= max(0.8, *shares) and L.told_apart(model["families"][c], L.plain(text), L.plain(text))
        name, chance, confirmed, *_ = L.scan_texts(pa.array([text]), model, 0.8)[0]
        assert confirmed == sure and name == (model["families"][c] if sure else L.UNKNOWN if like else None), text
        assert not like or chance == pytest.approx(p[c])


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
