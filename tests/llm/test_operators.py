import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from keystrata.llm import decontam, licenses, media, neardup, packing, sharding, substrings, tokens, toxicity, warc
from keystrata.llm.common import scratch
from keystrata.llm.components import connected_components
from keystrata.llm.tokenise import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return WORDS.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def shingle_set(text):
    w = lowered(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdefgéß") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage = text(70)
    out = [(i, text(rnd.choice([0, 3, 5, 60, 200]))) for i in range(60)]
    out += [(100 + i, out[40 + i][1]) for i in range(10)]  # copies
    base = text(120).split(" ")
    for i in range(30):  # near copies
        own = list(base)
        for _ in range(i % 6):
            own[rnd.randrange(len(own))] = "x" + rnd.choice(vocabulary)
        out.append((200 + i, " ".join(own)))
    out += [(300 + i, text(40) + "\n" + passage.upper() + "\n" + text(30)) for i in range(6)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, text(30_000)), (404, "Ünï  cödé  two  spaces \n"), (405, None)]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def best_capacity(sizes, shards):
    low, high = 1, sum(sizes)
    while low < high:
        mid, n, held = (low + high) // 2, 1, 0
        for s in sizes:
            if s > mid:
                n = shards + 1
                break
            n, held = (n + 1, s) if held + s > mid else (n, held + s)
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("points", [4, 8192])
def test_sharding(spark, docs, rows, points):
    out = sharding.shard_documents(docs, shards=7, points=points).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in rows)
    text, groups, shards = dict(rows), defaultdict(set), defaultdict(list)
    for r in out:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        groups[r.group_digest].add(r.shard)
        shards[r.shard].append(r)
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    sizes = defaultdict(int)
    for r in out:
        sizes[r.group_digest] += r.size
    assert max(sum(r.size for r in s) for s in shards.values()) == best_capacity([sizes[k] for k in sorted(sizes)], 7)
    assert sharding.shard_documents(empty(spark)).collect() == []


@pytest.mark.parametrize("points", [4, 8192])
def test_sharding_uses_all_shards_on_skew(spark, points):
    third = [(i, "x" * 984) for i in range(200)]  # one group of a third of the bytes
    others = [(1000 + i, f"{i:04d}" + "y" * 980) for i in range(400)]
    docs = spark.createDataFrame(third + others, "doc_id long, text string").repartition(3)
    sizes, digest = defaultdict(int), defaultdict(set)
    for r in sharding.shard_documents(docs, shards=40, points=points).collect():
        sizes[r.shard] += r.size
        digest[r.group_digest].add(r.shard)
    assert sorted(sizes) == list(range(40)) and all(len(s) == 1 for s in digest.values())
    large, *rest = sorted(sizes.values(), reverse=True)
    assert large == 200_000 and sum(rest) == 400_000 and max(rest) <= 11_000
    # two large groups of different sizes, and as many groups as shards
    few = spark.createDataFrame([(1, "a" * 50_000), (2, "b" * 20_000), (3, "c"), (4, "d"), (5, "e")], docs.schema)
    assert sorted(r.shard for r in sharding.shard_documents(few, shards=5, points=points).collect()) == list(range(5))
    assert len({r.shard for r in sharding.shard_documents(few, shards=8, points=points).collect()}) == 5
    # equal groups that don't fill the shards evenly
    assert len({r.shard for r in sharding.shard_documents(docs.where("doc_id between 1000 and 1099"), shards=40, points=points).collect()}) == 40


def test_token_files(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Encoder(path, True)
    manifest = tokens.write_token_files(docs, scratch(spark, "t"), path, frame_bytes=4096)
    out = tokens.read_token_files(spark, manifest).orderBy("doc_id").collect()
    start = 0
    for r, (i, text) in zip(out, sorted(rows), strict=True):
        ids = np.asarray([*plain.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.token_ids)) == (i, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    few = tokens.read_token_files(spark, manifest, doc_ids=[100, 403]).collect()
    assert sorted(r.doc_id for r in few) == [100, 403]
    file = manifest.orderBy("part").first().path
    fs, name = pafs.FileSystem.from_uri(file)
    reader = tokens.TokenFileReader(fs.open_input_file(name))
    reader.ids(0)
    assert reader.read_frames <= 2 < len(reader.entries) or len(reader.entries) <= 2
    assert tokens.read_token_files(spark, tokens.write_token_files(empty(spark), scratch(spark, "t"), path)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \n\t\u00a0\u2003\x1c\x85aA\u03a3\u00c9\u0301'sx1.\u4e8c", max_size=24))
def test_tokeniser_is_exact(text):
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        key = (name, keeps)
        if key not in _made:
            _made[key] = Encoder(public_tokenizers.path(name), keeps, remembered=5)
        assert _made[key].ids(text) == _made[key].whole(text)


_made = {}


def test_near_duplicates(spark, docs, rows):
    for percent in (80, 85):
        sets = {i: shingle_set(t) for i, t in rows}
        root = {i: i for i in sets}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        ids = sorted(sets)
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        out = neardup.near_duplicates(docs.union(docs.limit(5)), percent).distinct().collect()
        assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out} == {(i, len(sets[i]), find(i), find(i) == i) for i in ids}
    assert neardup.near_duplicates(empty(spark)).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e"), (3, "A b c d e"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(odd).collect()) == [(0, 0, True), (0, 3, False), (3, 3, True)]


def test_near_duplicates_groups_are_bounded(spark, monkeypatch):
    """Pages of one template that share bands but no link: what a task holds of a bucket is bounded on both sides."""
    rnd = random.Random(3)
    base, pages = [f"w{k}" for k in range(100)], []
    for i in range(160):
        at = rnd.randrange(85)
        pages.append((i, base[:at] + [f"p{i}x{k}" for k in range(15)] + base[at + 15 :]))
    pages += [(200 + i, w[:-1] + ["end"]) for i, w in pages[100:140]]
    pages = [(i, " ".join(w)) for i, w in pages]

    def bounded(made):
        def run(percent):
            work = made(percent)

            def checked(table):
                assert table.num_rows <= 48, table.num_rows
                return work(table)

            return checked

        return run

    monkeypatch.setattr(neardup, "BLOCK", 8)
    for name in ("_agreeing_members", "_compare_blocks"):
        if hasattr(neardup, name):
            monkeypatch.setattr(neardup, name, bounded(getattr(neardup, name)))
    sets = {i: shingle_set(t) for i, t in pages}
    component = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(component[a], component[b]), min(component[a], component[b])
                component = {i: new if c == old else c for i, c in component.items()}
    assert 100 < len(set(component.values())) < 165
    out = neardup.near_duplicates(spark.createDataFrame(pages, "doc_id long, text string"), 85).collect()
    assert {r.doc_id: r.component_id for r in out} == component


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 100)]
    out = dict(connected_components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_repeated_passages(spark, docs, rows):
    seen, expected = {}, []
    for i, text in sorted(rows):
        w, at = lowered(text), None
        for k in range(len(w) - 49):
            gram = tuple(w[k : k + 50])
            if gram not in seen:
                seen[gram] = i
            elif at is not None and k <= expected[-1][2]:
                expected[-1][2] = k + 50
            else:
                expected.append([i, k, k + 50, seen[gram]])
                at = k
    out = substrings.repeated_passages(docs.union(docs.limit(4))).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in out) == sorted(tuple(e[:3]) for e in expected)
    text = dict(rows)
    for r in out:  # an earlier document holds the span's first words
        passage = lowered(text[r.doc_id])[r.start_word : r.start_word + 50]
        w = lowered(text[r.earlier_doc_id])
        assert r.earlier_doc_id <= r.doc_id
        assert any(w[k : k + 50] == passage for k in range(len(w) - 49) if (r.earlier_doc_id, k) < (r.doc_id, r.start_word))
    cut = {r.doc_id: r.text for r in substrings.without_repeats(docs).collect()}
    spans = {e[0] for e in expected}
    assert all(cut[i] == t for i, t in rows if i not in spans)
    again = substrings.without_repeats(empty(spark)).collect()
    assert again == [] and all(len(lowered(t)) > 0 for i, t in cut.items() if i in spans)


def test_decontamination(spark, docs, rows):
    text = dict(rows)
    items = [(1, " ".join(lowered(text[40])[3:30]) if len(lowered(text[40])) > 30 else "zz"), (2, "none of these words is there at all"), (3, None), (4, "a b"), (5, " ".join((text[403] or "").split()[100:140]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for item, t in items:
        s = {g for g in shingle_set(t) if len(g) == 5}
        for i, d in rows:
            both = len(s & shingle_set(d))
            if s and 100 * both >= 80 * len(s):
                expected.add((item, i, len(s), both))
    assert {tuple(r) for r in decontam.contaminated(docs, bench).collect()} == expected and expected
    assert decontam.contaminated(empty(spark), bench).collect() == [] == decontam.contaminated(docs, bench.limit(0)).collect()
    assert decontam.decontaminate(docs, bench).count() == len(rows) - len({e[1] for e in expected})


def test_packing(spark, docs, rows):
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    out = packing.pack(pieces).collect()
    assert len(out) == pieces.count()
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = defaultdict(list)
    for r in out:
        lengths[r.doc_id].append((r.piece, r.start, r.length))
    assert all([p for p, _, _ in sorted(v)] == list(range(len(v))) and all(x[2] == 2048 for x in sorted(v)[:-1]) for v in lengths.values())
    assert packing.pack(packing.token_pieces(empty(spark), public_tokenizers.path("word_bpe_49k.json"))).collect() == []


def fewest(sizes, capacity):
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    left = dict(counts)
    fixed = packing.reduce_dominated(left, 20)
    rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
    assert sum(n for _, n in fixed) + (fewest(rest, 20) if rest else 0) == fewest(sorted(sizes, reverse=True), 20)
    used = defaultdict(int)
    for content, n in packing.plan(counts, 20):
        assert sum(content) <= 20
        for s in content:
            used[s] += n
    assert used == counts


@pytest.mark.parametrize("split", [200, 1 << 24])
def test_warc(spark, split):
    pages = spark.createDataFrame([(1, "http://a/", "<p>ä</p>"), (2, "http://b/\nX: y", "<p>ä</p>"), (3, None, None), (4, "u", ""), (5, "u", "z" * 300_000), (None, "u", "<p>ä</p>"), (6, "u", "WARC/1.1\r\n\r\n\x1f"), (5, "u", "z" * 300_000)], "page_id long, url string, html string").repartition(2)
    manifest = warc.write_warc(pages, scratch(spark, "w"))
    out = warc.read_warc(spark, manifest, split_bytes=split, with_payload=True).collect()
    import base64
    import hashlib

    text = {1: "<p>ä</p>", 2: "<p>ä</p>", 3: "", 4: "", 5: "z" * 300_000, None: "<p>ä</p>", 6: "WARC/1.1\r\n\r\n\x1f"}
    refers = {1: 2, None: 2, 3: 4}
    assert sorted(r.page_id or 0 for r in out) == [0, 1, 2, 3, 4, 5, 5, 6]
    for r in out:
        raw = text[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", refers[r.page_id]) if r.page_id in refers else ("response", None))
        assert r.record_type == "revisit" or bytes(r.payload) == raw
    nothing = warc.write_warc(pages.limit(0), scratch(spark, "w"))
    assert warc.read_warc(spark, nothing).collect() == []


def test_media(spark, docs, rows):
    import hashlib

    folder = scratch(spark, "m")
    media.write_archives(docs, folder, archive_bytes=20_000)
    out = {r.doc_id: r for r in media.media_features(media.read_archives(spark, folder, rangeBytes=5000)).collect()}
    assert sorted(out) == sorted(i for i, _ in rows)
    for i, text in rows:
        payload = media.padded((text or "").encode())
        r = out[i]
        assert len(payload) % 64 == 0 and payload and (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len((text or "").encode()), len(payload), zlib.crc32(payload[-64:]))
        stored = media.encode_image(payload)
        assert (r.payload_sha256, r.media_sha256, r.media_bytes) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest(), len(stored))



def test_member_is_retried(tmp_path):
    fs, root = pafs.FileSystem.from_uri(f"file://{tmp_path}")
    out = media.ArchiveWriter(fs, f"{root}/a.tar")
    out.add("1/3.png", b"abc"), out.add("2/3.png", b"def")
    out.close()
    with fs.open_input_file(f"{root}/a.tar") as source:
        assert media.read_member(source, out.offsets[1]) == ("2/3.png", b"def")
        with pytest.raises(ValueError):
            media.read_member(source, 100)


def test_licenses(spark):
    texts = ["Text.\nReleased under the MIT License.\nMore.", "licensed under the apache license, version 2.0", "Copyright of the sun and licence to roam", None, "", "All rights are reserved."]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    out = sorted((r.doc_id if r.doc_id is not None else 99, r.license, r.differences, r.exact) for r in licenses.license_notices(docs).collect())
    assert out == [(0, "MIT", 0, True), (1, "Apache-2.0", 0, False), (99, "MIT", 0, True)]
    row = licenses.license_notices(docs).where("doc_id = 0").first()
    assert texts[0][row.start : row.end] == "Released under the MIT License"


def test_licenses_are_all_found(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."
    texts = [
        "Licensed under the Apache License, Version 2.0. All rights reserved.",
        mpl,
        "Released under\r\n   the MIT\n\nLicense. Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.",
        "All rights reserved. " * 300,
        "Wholly free as in birdsong",
        "This work is licensed under the GNU General Public License, version 3.",
    ]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = defaultdict(list)
    for r in licenses.license_notices(docs).orderBy("doc_id", "start").collect():
        found[r.doc_id].append((r.license, r.differences))
        assert r.reduction > 0
    assert found == {
        0: [("Apache-2.0", 0), ("LicenseRef-reserved", 0)],
        1: [("MPL-2.0", 0)],
        2: [("MIT", 0), ("CC-BY-4.0", 0), ("CC-BY-NC-4.0", 0)],
        3: [("LicenseRef-reserved", 0)] * 300,
        5: [("GPL-3.0", 0)],
    }
    # more near templates than any fixed number, and one without the usual stems
    near = {f"V{k}": [f"This work is licensed under the Common Sharing Terms of the year, version {k}."] for k in range(9)}
    given = licenses.license_notices(docs.union(spark.createDataFrame([(7, near["V0"][0]), (8, near["V8"][0])], docs.schema)), templates=near | {"Bird": ["Free as in birdsong."]})
    assert sorted((r.doc_id, r.license) for r in given.collect()) == [(4, "Bird"), (7, "V0"), (8, "V8")]
    assert licenses.license_notices(docs, templates={}).collect() == []


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held_out = labels.where("doc_id % 4 = 0")
    chain = toxicity.fit_chain(docs, labels.where("doc_id % 4 <> 0"))
    scored = toxicity.toxicity(docs, chain).withColumnRenamed("toxic", "called").join(held_out, "doc_id").select("called", "toxic").collect()
    caught = sum(r.called and r.toxic for r in scored) / sum(r.toxic for r in scored)
    wrong = sum(r.called and not r.toxic for r in scored) / sum(not r.toxic for r in scored)
    assert caught >= 0.9 and wrong <= 0.02, (caught, wrong)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], SCHEMA)
    assert [r.toxic for r in toxicity.toxicity(odd, chain).collect()] == [False, False]
    none = toxicity.fit_chain(docs, labels.limit(0))
    assert toxicity.without_toxic(odd, none).count() == 2


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
