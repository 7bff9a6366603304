"""License scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are lines, and runs of several lines without a blank one, whose comment marks are taken off, as notices
are often wrapped; runs are cut into pieces of 2 * STEP words that overlap by half. Of a piece that has enough of a template's word bigrams somewhere, the stretch that has most of
them is a paragraph as well, so that a notice isn't lost in what surrounds it. Paragraphs are classified by a multinomial logistic regression over hashed word
unigrams and bigrams: one class a licence family, and a class for text that is no licence. It is trained here, on
varied copies of the family templates below and on a bounded, hash-chosen sample of at most about SAMPLE corpus
paragraphs as negatives. Probabilities are calibrated by a temperature, fitted on variations that training has not
seen, and the unknown class takes licence-like paragraphs whose best family stays below a threshold, fitted so
that families left out of training fall under it. A family is confirmed if at least `similar` of the word bigrams
of one of its templates are in the paragraph, all that hold a number or a word that tells licences apart among
them, and no other family has a larger share of one; and if what tells it from its nearest kin is there: its name in
the paragraph, or, as opening sentences are shared by kin, its own clauses in the document and none of the kin's
(NAMES, CLAUSES). Kin that share the opening (KIN) are tried in turn. A notice that says that something is not under a
licence confirms none.

Weights are sparse: a word or pair that no template has costs one lookup, so scanning is one pass without a
shuffle, and the model (FEATURES flags and the few weights that aren't zero) is of bounded size.

Defined results: a document's licence is the family of its most probable confirmed paragraph (ties: the first),
else UNKNOWN if a paragraph is licence-like, else null. n_paragraphs counts the lines that aren't blank, n_licenses the licence-like lines, or the
licence-like pieces of runs where they are more. A null or empty text has no paragraphs and no licence.
Repeated rows are each scanned; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches
from millrace.llm.textops import hash_strings, mix, odd_factors, slices, split_words, whole

SAMPLE, FEATURES, UNKNOWN = 4_000, 1 << 18, "unknown"
STEP = 112  # more than a stretch, which has twice the longest template's words at most
#: Marks of comments at the start and end of lines.
MARKS = r"^\s*(?:(?:/+\*+!?|\*+/?|/{2,}!?|#+|<!--+|--+|;+|%+|>+|\"{3}|'{3}|(?i:rem|dnl)\b)\s*)+|\s*(?:\*+/|--+>|\"{3}|'{3}|\*|#)?\s*$"
#: Notices by which texts are put under a licence, by family (fixed values; {y} a year, {h} a holder).
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "MIT licensed.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License version 3.", "Distributed under the GPL v3.", "Licensed under the GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License version 2.", "Distributed under the GPL v2.", "Licensed under the GPLv2.",
        "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the GNU Lesser General Public License version 2.1.", "Distributed under the LGPL v2.1.", "Licensed under the LGPLv2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.", "Released under the GNU Lesser General Public License version 3.", "Distributed under the LGPL v3.", "Licensed under the LGPLv3.",
        "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.", "Released under the GNU Affero General Public License version 3.", "Distributed under the AGPL v3.", "Licensed under the AGPLv3.",
        "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Released under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-2-Clause"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
#: What names a family in a paragraph, and what names its kin, whose names hold it; over words in lower case, one blank apart.
NAMES = {
    "MIT": (r"\bmit licen[sc]ed?\b|\bidentifier mit\b(?!-)", r"\bmit-0\b|\bmit no attribution\b|\bmit-[a-z]"),
    "Apache-2.0": (r"\bapache (?:software )?licen[sc]e (?:version |v ?)?2(?:\.0)?\b|\bapache[ -]2(?:\.0)?\b", None),
    "GPL-3.0": (r"\bgnu general public licen[sc]e\b.{0,120}\b(?:version |v ?)3\b|\bgpl[ -]?v?(?:ersion )?3(?:\.0)?\b", None),
    "GPL-2.0": (r"\bgnu general public licen[sc]e\b.{0,120}\b(?:version |v ?)2\b|\bgpl[ -]?v?(?:ersion )?2(?:\.0)?\b", None),
    "LGPL-2.1": (r"\blesser general public licen[sc]e\b.{0,120}\b(?:version |v ?)2\.1\b|\blgpl[ -]?v?(?:ersion )?2\.1\b", None),
    "LGPL-3.0": (r"\blesser general public licen[sc]e\b.{0,120}\b(?:version |v ?)3\b|\blgpl[ -]?v?(?:ersion )?3(?:\.0)?\b", None),
    "AGPL-3.0": (r"\baffero general public licen[sc]e\b.{0,120}\b(?:version |v ?)3\b|\bagpl[ -]?v?(?:ersion )?3(?:\.0)?\b", None),
    "CC-BY-NC-4.0": (r"\bcc[ -]by-nc[ -]4\.0\b|\battribution-noncommercial 4\.0\b", None),
    "CC-BY-4.0": (r"\bcc[ -]by[ -]4\.0\b|\bcommons attribution 4\.0\b", None),
    "CC-BY-SA-4.0": (r"\bcc[ -]by-sa[ -]4\.0\b|\battribution-sharealike 4\.0\b", None),
    "BSD-3-Clause": (r"\bbsd[ -]3[ -]clause\b|\b3[ -]clause bsd\b", r"\bbsd-3-clause-[a-z]"),
    "BSD-2-Clause": (r"\bbsd[ -]2[ -]clause\b|\b2[ -]clause bsd\b", r"\bbsd-2-clause-[a-z]"),
    "Unlicense": (r"\bunlicense\b|\bfree and unencumbered software released into the public domain\b", None),
    "ISC": (r"\bisc licen[sc]e\b|\bidentifier isc\b", None),
    "CC0-1.0": (r"\bcc0\b|\bhas waived all copyright and related or neighboring rights\b", None),
    "MPL-2.0": (r"\bmozilla public licen[sc]e (?:version |v ?)2\.0\b|\bmpl[ -]2\.0\b", None),
}
#: Of families whose texts don't name themselves: clauses that the document must have, and those that only kin have.
CLAUSES = {
    "MIT": (["permission is hereby granted free of charge to any person obtaining a copy", "above copyright notice and this permission notice shall be included in all copies"], ["shall not be used in advertising or otherwise to promote"]),
    "BSD-3-Clause": (["redistributions in binary form must reproduce the above copyright notice", "neither the name of"], ["all advertising materials mentioning features"]),
    "BSD-2-Clause": (["redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice", "this software is provided by"], ["neither the name of", "names of its contributors may", "all advertising materials mentioning features"]),
    "ISC": (["for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"], ["shall not be used in advertising or"]),
}
#: Families whose texts open with the same sentence, by the family that has it as a template.
KIN = {"BSD-3-Clause": ["BSD-2-Clause"]}
#: Words before a licence's name that turn a notice around.
NEGATED = r"\b(?:not|never|no longer|cannot|isn t|aren t|wasn t)\b(?: \S+){0,3} (?:licen[sc]ed|released|distributed|available|covered|provided|under)\b"
#: Words besides numbers that tell licences of one family of texts apart; a template's pairs with one, or with a
#: number, must all be in a text that it confirms.
TELLING = {"gpl", "lgpl", "agpl", "mit", "isc", "unlicense", "lesser", "library", "affero", "noncommercial", "attribution-noncommercial", "attribution-sharealike", "sharealike", "noderivatives", "attribution-noderivatives", "nc", "sa", "nd", "by-nc", "by-sa", "by"}
#: Licences that training doesn't see; the threshold of the unknown class is fitted on them.
OTHERS = [
    "Licensed under the Open Software License version 3.0.", "This document is licensed under the Free Art License.", "Distributed under the terms of the Eclipse Public License.",
    "Released under the Boost Software License.", "Licensed under the European Union Public Licence.", "You may use this text under the terms of the Academic Free License.",
]
#: Sentences near licences that are none.
NEGATIVES = [
    "All rights reserved.", "Copyright {y} {h}.", "The driver must carry a valid license at all times.", "The court granted permission to appeal.", "She released a new version of the song.", "The work is free of charge for members.",
    "The general public may use the software room under supervision.", "Version 3 of the plan was published this week.", "He was licensed as a pilot in {y}.", "Terms and conditions apply.",
]


def paragraphs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = pc.split_pattern(whole(texts), "\n")
    return lists.flatten(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))


def runs(parts: pa.Array, text: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces of runs of two or more lines without a blank one, without comment marks, and the place of each one's text."""
    bare = pc.replace_substring_regex(parts, MARKS, "")
    at = np.flatnonzero(np.asarray(pc.greater(pc.binary_length(bare), 0)).astype(bool)) if len(parts) else np.zeros(0, int)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(text[at]) > 0)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(at)))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    own = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), bare.take(pa.array(at[own], pa.int64())))
    words, offsets = split_words(pc.binary_join(lists, pa.scalar(" ", pa.large_string())))
    n = np.diff(offsets)
    many = np.maximum(-(-n // STEP) - 1, np.minimum(n, 1))
    run = np.repeat(np.arange(len(n)), many)
    begin = offsets[run] + STEP * (np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many))
    sizes = np.minimum(begin + 2 * STEP, offsets[run + 1]) - begin
    ends = np.concatenate([[0], np.cumsum(sizes)])
    own = np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(own, pa.int64())))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())), text[at[starts[run]]]


def stretches(parts: pa.Array, place: np.ndarray, feature: np.ndarray, grams: list[set], similar: float) -> tuple[list[str], list[int]]:
    """Of each piece and each template that may be in it, the stretch of up to twice the template's length with most
    of its bigrams, if they are enough; (texts, places of the pieces). place, feature: what the pieces have, once."""
    found, owner = [], []
    for g in grams:
        mine = np.zeros(FEATURES, bool)
        mine[list(g)] = True
        for i in np.flatnonzero(np.bincount(place[mine[feature]], minlength=len(parts)) >= similar * len(g)):
            one = parts.slice(int(i), 1)
            words, n = split_words(one)[0], len(split_words(one)[0])
            pairs = features(one)[1][n:]
            at = np.flatnonzero(mine[pairs])
            best = (0, 0, 0)
            for a, b in zip(at, np.searchsorted(at, at + 2 * len(g) + 8), strict=True):
                a_at = int(np.searchsorted(at, a))
                if b - a_at > best[0]:
                    best = max(best, (len(set(pairs[at[a_at:b]].tolist())), -int(a), int(at[b - 1]) + 2))
            if best[0] >= similar * len(g):
                found.append(" ".join(words.slice(-best[1], best[2] + best[1]).to_pylist()))
                owner.append(int(i))
    return found, owner


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, feature) of every word unigram and bigram."""
    words, offsets = split_words(texts)
    coded = words.dictionary_encode()
    core = pc.replace_substring_regex(coded.dictionary, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    h = hash_strings(core)[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    a, b = odd_factors(2)
    pairs = mix(h[:-1] * a + h[1:] * b)
    same = text[:-1] == text[1:]
    size = np.uint64(FEATURES)
    return np.concatenate([text, text[:-1][same]]), np.concatenate([mix(h) % size, pairs[same] % size]).astype(np.int64)


def bigram_sets(texts: pa.Array) -> list[set[int]]:
    """The word bigrams of each text, of a single word itself."""
    n = np.diff(split_words(texts)[1])
    place, feature = features(texts)
    words = int(n.sum())
    found = []
    for at, of in ((place[:words], feature[:words]), (place[words:], feature[words:])):
        cuts = np.searchsorted(at, np.arange(len(n) + 1))
        found.append([of[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return [set(pairs if many > 1 else own) for many, own, pairs in zip(n, *found, strict=True)]


def _bigrams(text: str) -> set[int]:
    return bigram_sets(pa.array([text], pa.large_string()))[0]


def _telling(text: str) -> set[int]:
    """The bigrams of a notice that hold a number or a word that tells licences apart."""
    words = [w.strip(".,;:()\"'").lower() for w in text.split()]
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if any(w in TELLING or any(c.isdigit() for c in w) for w in (a, b))]
    return set().union(*(_bigrams(p) for p in pairs))


def _once(place: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a text once."""
    keys = np.unique(place * FEATURES + feature)
    return keys // FEATURES, keys % FEATURES


def variations(text: str, rng: np.random.Generator, n: int) -> list[str]:
    """The notice with other years, holders, case, mark-up and surroundings."""
    holders = ["the authors", "Example Ltd.", "J. Doe", "the project contributors"]
    out = []
    for _ in range(n):
        own = text.format(y=1990 + int(rng.integers(40)), h=holders[rng.integers(4)])
        words = own.split()
        if len(words) > 8 and rng.random() < 0.5:
            words = words[: int(rng.integers(6, len(words) + 1))]
        if rng.random() < 0.3:
            words = [w for w in words if rng.random() > 0.08] or words
        own = " ".join(words)
        own = [own, own.upper(), own.lower(), own.title()][rng.choice(4, p=[0.6, 0.15, 0.15, 0.1])]
        own = [own, f"# {own}", f"* {own}", f"Copyright {holders[rng.integers(4)]}. {own}", f"{own} See the file for details."][rng.choice(5, p=[0.5, 0.1, 0.1, 0.15, 0.15])]
        out.append(own)
    return out


def _logits(texts: list[str], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = np.tile(bias, (len(texts), 1))
    place, feature = _once(*features(pa.array(texts, pa.large_string())))
    np.add.at(out, place, weights[feature])
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(negatives: list[str], seed: int = 7, steps: int = 150) -> dict:
    """Model from the templates and corpus paragraphs; the last class is no licence."""
    families, rng = list(TEMPLATES), np.random.default_rng(seed)
    grams = [[_bigrams(t) for t in TEMPLATES[f]] for f in families]
    telling = [[_telling(t) for t in TEMPLATES[f]] for f in families]
    like = [g for own in grams for g in own]
    place, feature = features(pa.array(negatives, pa.large_string()))
    owns: list[set] = [set() for _ in negatives]
    for i, f in zip(place, feature, strict=True):
        owns[i].add(f)
    clean = [t for t, own in zip(negatives, owns, strict=True) if not any(len(g & own) >= 0.5 * len(g) for g in like)]
    sets = []
    for _ in range(2):  # for training, and for calibration
        texts, y = [], []
        for c, f in enumerate(families):
            for t in TEMPLATES[f]:
                more = variations(t, rng, 40)
                texts, y = texts + more, y + [c] * len(more)
        none = [v for t in NEGATIVES for v in variations(t, rng, 12)]
        part = clean[len(sets) :: 2]
        sets.append((texts + none + part, np.array(y + [len(families)] * (len(none) + len(part)))))
    (texts, y), (held, held_y) = sets
    place, feature = _once(*features(pa.array(texts, pa.large_string())))
    # weights only for what the templates and negatives have
    kept = np.unique(features(pa.array([t for f in families for t in TEMPLATES[f]] + NEGATIVES))[1])
    column = np.full(FEATURES, -1)
    column[kept] = np.arange(len(kept))
    use = column[feature] >= 0
    place, feature = place[use], column[feature[use]]
    x = np.zeros((len(texts), len(kept)), np.float32)
    np.add.at(x, (place, feature), 1)
    w, b = np.zeros((len(kept), len(families) + 1)), np.zeros(len(families) + 1)
    b[-1] = 1.0
    one = np.eye(len(b))[y]
    share = 1 / np.bincount(y, minlength=len(b))[y]
    share[y == len(families)] *= len(families) / 2  # most text is no licence
    share = (share / share.sum())[:, None]
    m = v = 0.0
    theta = np.vstack([w, b])
    for step in range(1, steps + 1):
        p = _softmax(x @ theta[:-1] + theta[-1])
        g = (p - one) * share
        gradient = np.vstack([x.T @ g, g.sum(axis=0)]) + 1e-4 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros((FEATURES, len(b)))
    weights[kept] = theta[:-1]
    z = _logits(held, weights, theta[-1])
    rows = np.arange(len(held_y))
    losses = {t: -np.log(_softmax(z / t)[rows, held_y] + 1e-12).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)}
    temperature = min(losses, key=losses.get)
    strange = _softmax(_logits([v for t in OTHERS for v in variations(t, rng, 10)], weights, theta[-1]) / temperature)[:, :-1].max(axis=1)
    threshold = float(np.clip(np.quantile(strange, 0.9), 0.5, 0.95))
    return {"families": families, "grams": grams, "telling": telling, "kept": kept, "weights": theta[:-1], "bias": theta[-1], "temperature": temperature, "threshold": threshold}


def plain(text: str) -> str:
    """A text's words in lower case, one blank apart, without comment marks and punctuation around them."""
    bare = re.sub(MARKS, " ", text.lower(), flags=re.MULTILINE)
    return re.sub(r"\s+", " ", re.sub(r"[^\w.+/-]+|\.(?=\s|$)|(?<=\s)[-./]+(?=\s)", " ", bare)).strip()


def told_apart(family: str, paragraph: str, document: str, around: str = "") -> bool:
    """Whether what tells a family from its kin is there, and nothing turns it around, in the paragraph or in the words
    before it where it is a part of a longer text `around`. All texts are plain."""
    at = around.find(paragraph)
    if re.search(NEGATED, around[max(0, at - 40) : at] + paragraph):
        return False
    name, kin = NAMES[family]
    if re.search(name, paragraph):
        return not (kin and re.search(kin, paragraph))
    own, others = CLAUSES.get(family, ([], []))
    return bool(own) and all(c in document for c in own) and not any(c in document for c in others)


def scan_texts(texts: pa.Array, model: dict, similar: float) -> list[tuple]:
    """(family or UNKNOWN or None, probability, confirmed, paragraphs, licence-like paragraphs) of each text."""
    parts, text = paragraphs(texts)
    full = np.bincount(text[np.asarray(pc.greater(pc.binary_length(pc.utf8_trim_whitespace(parts)), 0)).astype(bool)], minlength=len(texts)) if len(parts) else np.zeros(len(texts), int)
    joined, of = runs(parts, text)
    lines, n_runs = len(parts), len(joined)
    place, feature = features(pa.concat_arrays([parts.cast(pa.large_string()), joined]))
    # notices of two or three words stand in a line; of those, the hashes of some other words would be taken for one everywhere
    wrapped = [g for own in model["grams"] for g in own if len(g) >= 3]
    wanted = np.zeros(FEATURES, bool)
    wanted[[x for g in wrapped for x in g]] = True
    in_run = (place >= lines) & wanted[feature]
    more, owner = stretches(joined, *_once(place[in_run] - lines, feature[in_run]), wrapped, similar)
    extra = features(pa.array(more, pa.large_string()))
    place, feature = np.concatenate([place, extra[0] + lines + n_runs]), np.concatenate([feature, extra[1]])
    parts = pa.concat_arrays([x.cast(pa.large_string()) for x in (parts, joined, pa.array(more, pa.large_string()))])
    text = np.concatenate([text, of, of[np.array(owner, int)]])
    run = np.concatenate([np.full(lines, -1), np.arange(n_runs), np.array(owner, int)])
    column = np.full(FEATURES, -1, np.int32)
    column[model["kept"]] = np.arange(len(model["kept"]))
    use = column[feature] >= 0
    place, feature = _once(place[use], feature[use])
    some, inverse = np.unique(place, return_inverse=True)
    z = np.tile(model["bias"], (len(some), 1))
    np.add.at(z, inverse, model["weights"][column[feature]])
    p = _softmax(z / model["temperature"]) if len(some) else z
    like = np.flatnonzero(p[:, :-1].sum(axis=1) >= 0.5) if len(some) else np.zeros(0, int)
    out = [(None, 0.0, False, int(n), 0) for n in full]
    wholes: dict[int, str] = {}
    # only these may be confirmed
    sure_ones = like[p[like, :-1].max(axis=1) >= model["threshold"]] if len(like) else like
    sets = dict(zip(sure_ones.tolist(), bigram_sets(parts.take(pa.array(some[sure_ones], pa.int64()))), strict=True)) if len(sure_ones) else {}
    for i in like:
        at = text[some[i]]
        family = int(p[i, :-1].argmax())
        chance = float(p[i, family])
        confirmed = int(i) in sets
        if confirmed:
            own = sets[int(i)]
            # the share of each family's nearest template; another family's may not be nearer than that of the class
            shares = [max((len(g & own) / len(g) for g, t in zip(*x, strict=True) if t <= own), default=0.0) for x in zip(model["grams"], model["telling"], strict=True)]
            confirmed = shares[family] >= max(similar, *shares)
        if confirmed:
            if at not in wholes:
                wholes[at] = plain(texts[int(at)].as_py())
            shown = plain(parts[int(some[i])].as_py())
            around = plain(joined[int(run[some[i]])].as_py()) if some[i] >= lines + n_runs else ""
            names = [model["families"][family], *KIN.get(model["families"][family], [])]
            right = next((f for f in names if told_apart(f, shown, wholes[at], around)), None)
            confirmed, family = right is not None, family if right is None else model["families"].index(right)
        name, best, sure, n, found = out[at]
        if (confirmed, chance) > (sure, best):
            name, best, sure = (model["families"][family] if confirmed else UNKNOWN), chance, confirmed
        out[at] = (name or UNKNOWN, best, sure, n, found + (run[some[i]] < 0))
    kinds = np.unique(run[some[like]]) if len(like) else np.zeros(0, int)
    in_runs = np.bincount(of[kinds[kinds >= 0]], minlength=len(texts))
    return [(*o[:4], max(int(o[4]), int(k))) for o, k in zip(out, in_runs, strict=True)]


def corpus_paragraphs(docs: DataFrame, sample: int) -> list[str]:
    """At most about `sample` paragraphs, of documents chosen by a hash of their id."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    share = min(1.0, sample / 4 / max(rows.count(), 1))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    parts = rows.select(F.explode(F.split("text", "\n")).alias("part")).where("part <> '' AND pmod(xxhash64(part), 4) = 0").distinct()
    return sorted(r.part for r in parts.orderBy(F.xxhash64(F.lit(2), "part"), "part").limit(sample).collect())


def scan(docs: DataFrame, similar: float = 0.8, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, license, probability, confirmed, n_paragraphs, n_licenses) of every row of docs."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(corpus_paragraphs(docs, sample)))
    schema = "doc_id long, license string, probability double, confirmed boolean, n_paragraphs int, n_licenses int"

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                rows = scan_texts(piece.column("text"), model.value, similar)
                kinds = [pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.int32()]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
