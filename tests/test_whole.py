"""Operators and queries do their whole job: brute force over small tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.functions import text
from lanewise.llm import licenses
from lanewise.operators import dedupe, distill
from lanewise.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_near_duplicate_pairs_of_long_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: set(re.findall(r"\w+", (r.text or "").lower())) for r in docs}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    long = {r.doc_id for r in docs if len(r.text or "") > 600}
    assert any(a in long for a, _ in want)
    got = QUERIES["near_duplicate_pairs_whole"](spark, SF).collect()
    assert {p for p in _expanded(got)} == want and len(got) == len({(r.left_id, r.right_id) for r in got})


def _expanded(rows):
    """All pairs of ids that pairs of classes and their members stand for."""
    members = {}
    for r in rows:
        members.setdefault(r.left_id, {r.left_id})
        if r.same_set:
            members[r.left_id].add(r.right_id)
        else:
            members.setdefault(r.right_id, {r.right_id})
    for of in members.values():
        yield from ((a, b) for a in of for b in of if a < b)
    for r in rows:
        if not r.same_set:
            yield from ((min(a, b), max(a, b)) for a in members[r.left_id] for b in members[r.right_id])


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_near_duplicate_classes_of_sets_of_all_sizes(spark, threshold, monkeypatch):
    from lanewise.operators import similar

    monkeypatch.setattr(similar, "BLOCK", 1_500)
    monkeypatch.setattr(similar, "STEP", 3_000)
    monkeypatch.setattr(similar, "SAMPLE", 60)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[int(k)] for k in rng.zipf(1.2, rng.integers(1, 200)) % 300)) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " " + " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(60)]
    rows += [(300 + i, rows[i % 3 + 5][1]) for i in range(60)] + [(400, None), (401, ""), (402, " .,"), (None, rows[0][1])]
    sets = {i: set(t.split()) for i, t in rows if i is not None and i < 400}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = similar.near_duplicate_classes(df, threshold).collect()
    pairs = list(_expanded(got))
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert all(r.similarity == pytest.approx(len(sets[r.left_id] & sets[r.right_id]) / len(sets[r.left_id] | sets[r.right_id])) for r in got)
    # copies are members, not pairs: links do not grow with the square of a group
    assert sum(r.same_set for r in got) == len(sets) - len({frozenset(s) for s in sets.values()})
    assert similar.near_duplicate_classes(df.where("id >= 400"), threshold).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_near_duplicates_of_sets_of_all_sizes(spark, threshold, monkeypatch):
    monkeypatch.setattr(dedupe, "COMMON", 20)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[int(k)] for k in rng.zipf(1.2, rng.integers(1, 200)) % 300)) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " " + " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    left, right = df.where("id < 150"), df.where(F.col("id") >= 50)
    sets = {i: set(t.split()) for i, t in rows}
    want = {(a, b) for a in sets if a < 150 for b in sets if b >= 50 and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    assert {(r.left_id, r.right_id) for r in dedupe.near_duplicates(left, right, threshold).collect()} == want


def _licences(spark, texts):
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r.families, r.n_notices) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_all_notices_of_a_line(spark):
    mit, apache = "released under the MIT License. ", "licensed under the Apache License, Version 2.0. "
    texts = [
        mit + "word " * 3000 + apache, "Licensed under the MIT License or the Apache License, Version 2.0.", mit + "word " * 3000 + mit, mit * 3,
        "licensed under the GNU Lesser General Public License version 3", "licensed under the GNU General Public License version 3 or the GNU Lesser General Public License", apache,
    ]
    assert _licences(spark, texts) == [
        (["apache-2.0", "mit"], 2), (["apache-2.0", "mit"], 2), (["mit"], 2), (["mit"], 3), (["lgpl"], 1), (["gpl-3.0", "lgpl"], 2), (["apache-2.0"], 1),
    ]


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights""",
    "bsd": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:""",
    "isc": """ * Permission to use, copy, modify, and/or distribute this software for any\r
 * purpose with or without fee is hereby granted, provided that the above\r
 * copyright notice and this permission notice appear in all copies.""",
    "gpl-3.0": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.""",
    "proprietary": "All rights\n# reserved.",
}


def test_wrapped_notices(spark):
    texts = [f"Some words first.\n\n{t}\n \t\nMore words." for t in WRAPPED.values()] + ["\n\n".join(WRAPPED.values())]
    assert _licences(spark, texts) == [([f], 1) for f in WRAPPED] + [(sorted(WRAPPED), len(WRAPPED))]


def test_tfidf_weights_of_the_whole_vocabulary(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", text.tokens(text.excerpt_text(F.col("text"))).alias("w")).collect()
    df = Counter(w for r in docs for w in set(r.w))
    vocab = sorted((w for w in df if df[w] >= distill.MIN_DF), key=lambda w: (-df[w], w))[: distill.MAX_VOCAB]
    idf = {w: math.log((1 + len(docs)) / (1 + df[w])) + 1 for w in vocab}
    assert len(vocab) > 100 and any("_" in w for w in vocab)
    want = {}
    for r in docs:
        row = {w: (1 + math.log(n)) * idf[w] for w, n in Counter(r.w).items() if w in idf}
        norm = math.sqrt(sum(v * v for v in row.values()))
        want |= {(r.doc_id, w): v / norm for w, v in row.items()}
    got = {(r.doc_id, r.token): r.value for r in QUERIES["tfidf_weights_whole"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_identifiers_and_topics_past_the_excerpt(spark, tmp_path):
    late = "word " * 1000 + "My SSN is 123-45-6789 and HIPAA applies."
    spark.createDataFrame([(1, late, "en", "a"), (2, None, "en", "a")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/customer.parquet").limit(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.doc_id: r.us_ssn for r in QUERIES["detect_identifiers_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 0}
    topics = {r.id: sum(r[1:]) for r in QUERIES["detect_advisory_topics_whole"](spark, str(tmp_path)).collect()}
    assert topics[-2] > 0 and topics[-3] == 0


def test_payloads_of_all_turns(spark):
    want: dict[int, list[int]] = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        row = want.setdefault(r.conv_id, [1, 8] if r.conv_id % 3 == 0 else [0, 0])
        row[0] += 1
        row[1] += len(r.text)
    assert max(n for n, _ in want.values()) > 2
    assert {r.id: [r.turns, r.n] for r in QUERIES["payload_messages_whole"](spark, SF).collect()} == want


def test_cache_hits_walk_a_key_without_gathering_it(spark):
    """Rows of one key and order stay one row each, a null key is a key, and no row holds a key's history."""
    rows = [("a", i // 2, float(i)) for i in range(5_000)] + [(None, i, float(7 * i)) for i in range(4)] + [("b", 0, None), ("b", 1, 5.0), ("b", 2, 6.0)]
    hits = dedupe.cache_hits(spark.createDataFrame(rows, "k string, o long, t double"), "k", "o", ttl_seconds=10, ts="t")
    want, stored = [], {}
    for k, o, t in rows:
        hit = t is not None and stored.get(k) is not None and t - stored[k] < 10
        if not hit:
            stored[k] = t
        want.append((k or "", o, -1.0 if t is None else t, hit))
    assert sorted((r.k or "", r.o, -1.0 if r.t is None else r.t, r.hit) for r in hits.collect()) == sorted(want)
    assert "collect_list" not in hits._jdf.queryExecution().toString()


def test_notices_without_their_usual_words(spark):
    """Whatever the screen keeps from the classifier could not have been confirmed: notices that lack any one or two words."""
    model, texts = licenses.Model(), []
    for t in (t for ts in licenses.TEMPLATES.values() for t in ts):
        words = sorted(set(licenses.words_of(t)))
        for i, a in enumerate(words):
            texts += [" ".join(w for w in licenses.words_of(t) if w not in (a, b)) for b in words[i:]]
    texts = [*texts[::7], "All rights_reserved", "this is free and software released into the", "Granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"]
    want = [(sorted({f for f, _ in model.notices(t)}), len(model.notices(t))) for t in texts]
    assert sum(n for _, n in want[-3:]) == 3
    assert _licences(spark, texts) == want
