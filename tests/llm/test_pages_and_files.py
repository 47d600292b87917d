"""op4, op7 and op8 against brute force, and their edge cases."""

import gzip
import math
import re
import random

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from citegraph.llm import licenses, media, queries, warc

RECORD = "record_id long, url string, time long, type string, digest string, etag string, last_modified string, headers map<string,string>, extra int"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert compare.differences(spark, compare.duck(sf), name, queries.QUERIES[name], queries.ORACLE_SQL[name], sf) == ""


def test_canonical_urls(spark):
    same = ["http://www.Example.com/a/", "https://example.com:443/a?utm_source=x#top", "http://user@example.com/a/index.html"]
    rows = spark.createDataFrame([(u,) for u in [*same, "http://example.com/a?b=2&a=1", None]], "url string").select(warc.canonical_url(F.col("url")).alias("c")).collect()
    assert [r.c for r in rows] == ["example.com/a"] * 3 + ["example.com/a?a=1&b=2", None]


@pytest.mark.parametrize("slice_rows", [5, 10_000])
def test_revisits_equal_a_scan(spark, slice_rows):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        kind = rng.choice(["response", "revisit", "revisit", "metadata"])
        url = rng.choice(["http://hot.com/"] * 5 + [f"http://h{rng.randint(0, 4)}.com", None])
        rows.append((i if rng.random() > 0.03 else None, url, rng.choice([None, *range(40)]), kind, rng.choice([None, "d1", "d1", "d2"]), rng.choice([None, '"e"', 'W/"e"']), None, rng.choice([None, {"etag": '"n"', "content-length": "0"}]), 1))
    got = warc.resolve(spark.createDataFrame(rows, RECORD), slice_rows).collect()
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    for r in got:
        if r.record_id is None:
            continue
        me = rows[r.record_id]
        before = [x for x in rows if x[3] == "response" and x[0] is not None and x[1] and x[1] == me[1] and None not in (x[2], me[2]) and x[2] < me[2]]
        if not before:
            assert r.status == "unresolved" and r.response_id is None
            continue
        best = max(before, key=lambda x: (x[2], x[0]))
        tag = lambda t: t and t.removeprefix("W/")
        ok = me[4] == best[4] if me[4] and best[4] else tag(me[5]) == tag(best[5]) if me[5] and best[5] else True
        assert (r.status, r.response_id) == (("resolved", best[0]) if ok else ("contradicted", None))
        if ok:
            assert r.headers == {k: v for k, v in (best[7] or {}).items() if not (me[7] and k == "etag")} | ({"etag": '"n"'} if me[7] else {})
    assert warc.resolve(spark.createDataFrame([], RECORD)).collect() == []


def test_warc_files(spark, tmp_path):
    def record(kind, date, head, body):
        block = f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://a.com/\r\nWARC-Date: {date}\r\nWARC-Record-ID: <{kind}>\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    one, two = record("response", "2020-01-01T00:00:00Z", 'ETag: "e"', b"<p>hi</p>"), record("revisit", "2020-01-02T00:00:00Z", "Age: 5", b"")
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "cut.warc").write_bytes(one[:-20])
    rows = warc.read_warc(spark, str(tmp_path)).withColumn("record_id", F.xxhash64("warc_id"))
    assert rows.count() == 2
    (r,) = warc.resolve(rows).collect()
    assert r.status == "resolved" and r.headers == {"etag": '"e"', "age": "5"} and r.response_time == 1577836800000000


def _picture(seed: int, side: int = 96) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 255, (side // 8, side // 8)), np.ones((8, 8))).astype(np.uint8)


def test_op7_finds_crops_and_edits(spark):
    base = _picture(1, 128)
    images = {
        1: base, 2: base, 3: base[16:112, 8:120], 4: np.clip(base * 0.8 + 20, 0, 255).astype(np.uint8), 5: np.clip(base.astype(int) + np.random.default_rng(0).integers(-3, 4, base.shape), 0, 255).astype(np.uint8), 6: np.rot90(base),
        7: _picture(7, 128), 8: _picture(8, 128), 9: np.full((64, 64), 9, np.uint8), 10: np.full((64, 64), 9, np.uint8),
    }
    rows = [(k, bytearray(np.ascontiguousarray(v).tobytes()), v.shape[1], "x") for k, v in images.items()] + [(11, None, None, "x"), (12, None, None, "x"), (13, bytearray(b""), 4, "x"), (None, bytearray(b"abc"), 0, "x")]
    got = {r.image_id: r.class_id for r in media.copies(spark.createDataFrame(rows, "image_id long, pixels binary, width int, key string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 8, 9: 9, 10: 9, 11: 11, 12: 11, 13: 13, None: None}
    assert media.copies(spark.createDataFrame([], "image_id long, pixels binary, width int")).collect() == []


def test_op7_compares_pairs_that_share_one_word(spark):
    """Copies enlarged by 1.2 share a word or two with their originals, in buckets of two, and agree on enough corners."""
    at = ((np.arange(153) + 0.5) / 1.2).astype(int)
    images = {k: _picture(k, 128) for k in (1, 2, 3)}
    images |= {k + 10: v[np.ix_(at, at)] for k, v in images.items()}
    rows = [(k, bytearray(np.ascontiguousarray(v).tobytes()), v.shape[1]) for k, v in images.items()]
    got = {r.image_id: r.class_id for r in media.copies(spark.createDataFrame(rows, "image_id long, pixels binary, width int")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 11: 1, 12: 2, 13: 3}


def test_op7_equals_all_pairs_that_share_a_word(spark, monkeypatch):
    """Pictures of two shades have many words in common by chance, and small blocks make every bucket several of them."""
    monkeypatch.setattr(media, "BLOCK", 3)
    rng = np.random.default_rng(11)
    images = {}
    for k in range(8):
        base = np.kron(rng.integers(0, 2, (16, 16)) * 120 + 60, np.ones((8, 8))).astype(np.uint8)
        images |= {k: base, k + 40: base[9:, 7:], k + 20: np.clip(base * 0.7 + 30, 0, 255).astype(np.uint8), k + 60: np.clip(base.astype(int) + rng.integers(-6, 7, base.shape), 0, 255).astype(np.uint8)}
    found = {}
    for k, v in images.items():
        y, x, scale, turn, words = media.corners(v)
        found[k] = np.concatenate([np.stack([y, x, scale, turn], 1).astype(np.int64), words.astype(np.int64)], 1)
    label, met = {k: k for k in images}, 0
    for a in sorted(images):
        for b in sorted(images):
            if a < b and any(len(np.intersect1d(found[a][:, c], found[b][:, c])) for c in range(4, 8)):
                met += 1
                if media.inliers(found[a], found[b]) >= media.INLIERS:
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if v == high else v for k, v in label.items()}
    rows = [(k, bytearray(np.ascontiguousarray(v).tobytes()), v.shape[1]) for k, v in images.items()]
    got = {r.image_id: r.class_id for r in media.copies(spark.createDataFrame(rows, "image_id long, pixels binary, width int")).collect()}
    assert got == label and met > 100 and 1 < len(set(label.values())) < len(label)


def _join_rows(spark, since: int) -> tuple[int, int]:
    """Rows that inner joins of rep with rep made in the executions from `since` on, and the number of executions."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    ids = [runs.apply(i).executionId() for i in range(runs.size())]
    for run in (i for i in ids if i >= since):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if re.search(r"Join \[rep#\d+L?\], \[rep#\d+L?\], Inner", node.desc()):
                of = {node.metrics().apply(i).name(): node.metrics().apply(i).accumulatorId() for i in range(node.metrics().size())}
                made += int(values.get(of["number of output rows"]).get().replace(",", ""))
    return made, max(ids, default=-1) + 1


def test_op7_sends_an_image_once_for_each_leader(spark, monkeypatch):
    """All words of one least image go with one group; slices of it find the same links."""
    rng, images = np.random.default_rng(5), {}
    for k in range(12):
        base = np.kron(rng.integers(0, 2, (16, 16)) * 120 + 60, np.ones((8, 8))).astype(np.uint8)
        images |= {k: base, k + 20: np.clip(base * 0.7 + 30, 0, 255).astype(np.uint8), k + 40: base[9:, 7:]}
    found, buckets = {}, {}
    for k, v in sorted(images.items()):
        y, x, scale, turn, words = media.corners(v)
        found[k] = np.concatenate([np.stack([y, x, scale, turn], 1).astype(np.int64), words.astype(np.int64)], 1)
        for w in {(c, int(word)) for c in range(4) for word in words[:, c]}:
            buckets.setdefault(w, []).append(k)
    shared = [b for b in buckets.values() if len(b) > 1]
    assert max(map(len, shared)) <= media.BLOCK and max(map(len, shared)) > 3
    label = {k: k for k in images}
    pairs = sorted({(a, b) for m in shared for a in m for b in m if a < b})
    good = [media.inliers(found[a], found[b]) >= media.INLIERS for a, b in pairs]
    for (a, b), linked in zip(pairs, good, strict=True):
        if linked:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}

    rows = [(k, bytearray(np.ascontiguousarray(v).tobytes()), v.shape[1]) for k, v in images.items()]
    table = spark.createDataFrame(rows, "image_id long, pixels binary, width int")
    _, before = _join_rows(spark, 1 << 60)
    assert {r.image_id: r.class_id for r in media.copies(table).collect()} == label
    made, _ = _join_rows(spark, before)
    assert made == len({(m[0], k) for m in shared for k in m})

    monkeypatch.setattr(media, "GROUP", 4)
    assert {r.image_id: r.class_id for r in media.copies(table).collect()} == label

    order = sorted(images)
    left, right = (np.array([order.index(p[side]) for p in pairs]) for side in (0, 1))
    may = media._may_agree([found[k] for k in order], left, right)
    assert may[np.array(good)].all() and 0 < sum(good) < len(good)


def _cosine(unit: str, df: dict, n: int) -> tuple[float, int]:
    idf = lambda t: math.log((1 + n) / (1 + df.get(t, 0))) + 1
    mine: dict = {}
    for t in licenses.terms_of(unit):
        mine[t] = mine.get(t, 0) + 1
    best = (0.0, 0)
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        theirs: dict = {}
        for t in licenses.terms_of(text):
            theirs[t] = theirs.get(t, 0) + 1
        dot = sum(c * mine.get(t, 0) * idf(t) ** 2 for t, c in theirs.items())
        norm = math.sqrt(sum((c * idf(t)) ** 2 for t, c in mine.items()) * sum((c * idf(t)) ** 2 for t, c in theirs.items()))
        best = max(best, (round(min(1.0, dot / norm), 9) if norm else 0.0, -i))
    return best


def test_op8_equals_brute_force(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "no word of it"), ("a/b/c/LICENSE.md", "Licensed under the Apache License, Version 2.0.\nMore."), ("a/b/c/d/y.txt", None), ("z.txt", "Intro.\nThis work is licensed under the GNU General Public License, version 3. Bye."),
        ("q/w.txt", ""), ("q/copy.txt", "the copyright of bananas in general, a long sentence that no template has"), (None, "Licensed under CC BY-NC 4.0."), ("a/b/x.txt", "no word of it"),
    ]
    rows = licenses.scan(spark.createDataFrame([(i, *f, "k") for i, f in enumerate(files)], "id int, path string, text string, license string"), "id").collect()
    got = {r.id: (r.license, r.origin, r.licensed_by) for r in rows}
    assert len(rows) == len(files)
    assert got == {0: ("MIT", "own", None), 1: ("MIT", "inherited", "a"), 2: ("Apache-2.0", "own", None), 3: ("Apache-2.0", "inherited", "a/b/c"), 4: ("GPL-3.0", "own", None), 5: (None, "none", None), 6: (None, "none", None), 7: ("CC-BY-NC-4.0", "own", None), 8: ("MIT", "inherited", "a")}
    speaks = lambda s: re.search(licenses.SPEAKS, s)
    split = lambda rule, s: re.split(rule, s)
    units = []
    for path, text in files:
        joined = [" ".join(p.split("\n")) for p in split(licenses.PARAGRAPHS, text or "")]
        mine = [text] if text and re.search(licenses.LICENCE_FILE, path or "") else []
        mine += [u for u in [*split(licenses.SENTENCES, text or ""), *joined, *(s for p in joined for s in split(licenses.ENDS, p))] if speaks(u)]
        units += dict.fromkeys(mine)
    df: dict = {}
    for u in units:
        for t in set(licenses.terms_of(u)):
            df[t] = df.get(t, 0) + 1
    score = lambda *of: max(_cosine(u, df, len(units)) for u in of)
    apache, gpl = files[2][1], "This work is licensed under the GNU General Public License, version 3."
    want = {0: score(files[0][1]), 4: score(gpl), 2: score(apache, apache[:-6]), 7: score(files[7][1])}
    for r in rows:
        if r.id in want:
            assert r.score == pytest.approx(want[r.id][0], abs=1e-8)
    assert licenses.scan(spark.createDataFrame([], "id int, path string, text string"), "id").collect() == []


def test_op8_joins_the_lines_of_wrapped_notices(spark):
    """Notices as their publishers wrap them, with the marks of several kinds of comments, and line ends of all kinds."""
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    gnu = "This {0} is free software{1} you can redistribute it and/or modify\nit under the terms of the GNU {2}General Public License as published by\nthe Free Software Foundation{3} either version {4} of the License, or\n(at your option) any later version."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0'
    notices = [
        ("MPL-2.0", mpl), ("Apache-2.0", apache), ("GPL-2.0", gnu.format("program", ";", "", ";", 2)), ("GPL-3.0", gnu.format("program", ":", "", ",", 3)), ("LGPL-3.0", gnu.format("library", ":", "Lesser ", ",", 3)),
        ("LGPL-2.1", gnu.format("library", ";", "Lesser ", ";", "2.1")), ("AGPL-3.0", gnu.format("program", ":", "Affero ", ",", 3)), ("MIT", "Released under the\nMIT License"),
    ]
    styles = [lambda t: t, lambda t: "\n".join("# " + x for x in t.split("\n")), lambda t: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */", lambda t: "// " + t.replace("\n", "\r\n// ")]
    rows = [(f"{i}.{j}", f"s/{i}_{j}.c", style(text) + "\n\nint main() { return 0; }") for i, (_, text) in enumerate(notices) for j, style in enumerate(styles)]
    rows.append(("none", "s/n.c", "# All that follows\n# is code of the house.\n\nint a;"))
    got = {r.id: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "id string, path string, text string"), "id").collect()}
    assert got == {"none": (None, "none")} | {f"{i}.{j}": (name, "own") for i, (name, _) in enumerate(notices) for j in range(len(styles))}
