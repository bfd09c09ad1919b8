"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, against plain computations."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from keystrata.llm import common, decontam, licenses, media, neardup, packing, sharding, substrings, tokens, toxicity, warc
from keystrata.llm.common import filesystem, scratch
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["part", "place", "offset", "sequence_id", "spans", "words_left", "salt", "digest", "bucket", "hub", "shingle", "code", "last", "size", "start", "n_tokens", "refers_to", "toxic", "item_id", "rows"]


def lowered(text):
    return WORDS.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def words_text(rnd, n, size=300):
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    shared = words_text(rnd, 80)
    out = [(i, words_text(rnd, rnd.choice([1, 4, 30, 120]))) for i in range(20)]
    out += [(30, words_text(rnd, 40) + " " + shared), (31, shared + " " + words_text(rnd, 20)), (32, shared), (32, shared), (32, "other words " + shared + " at the end")]
    out += [(33, words_text(rnd, 90)), (33, words_text(rnd, 10)), (None, shared), (None, None), (40, None), (41, ""), (42, " \n "), (43, words_text(rnd, 20_000)), (44, "x" * 100_000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return made.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


def test_columns_of_any_name_are_kept(spark, docs, rows):
    n = len(rows)
    assert sharding.shard_documents(docs, 5).count() == n
    assert neardup.near_duplicates(docs).count() == n
    assert media.media_features(media.read_archives(spark, scratch(spark, "m"), media.write_archives(docs, scratch(spark, "m")))).count() == n
    bench = spark.createDataFrame([(1, "none of these words is there", 3)], "item_id long, text string, code int")
    assert decontam.contaminated(docs, bench).count() == 0
    for kept in (decontam.decontaminate(docs, bench), neardup.without_near_duplicates(docs), substrings.without_repeats(docs)):
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.select(CLASHES).distinct().collect()} == {tuple(range(len(CLASHES)))}
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.token_pieces(docs, path).withColumns({c: F.lit(i) for i, c in enumerate(CLASHES) if c not in ("start",)})
    packed = packing.pack(pieces)
    assert sorted(packed.columns) == sorted(pieces.columns) and packed.count() == pieces.count()
    assert {tuple(r) for r in packed.select("part", "place", "hub").distinct().collect()} == {(0, 1, 9)}
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, None)], "doc_id long, piece int, length long"))
    assert licenses.license_notices(docs).count() == 0
    assert tokens.read_token_files(spark, tokens.write_token_files(docs, scratch(spark, "t"), public_tokenizers.path("byte_bpe_50k.json"))).count() == n


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    folder = scratch(spark, "m")
    assert media.media_features(media.read_archives(spark, folder, media.write_archives(none, folder))).collect() == []
    assert media.read_archives(spark, scratch(spark, "nothing")).collect() == []
    assert licenses.license_notices(none).collect() == [] == substrings.repeated_passages(none).collect()
    assert neardup.without_near_duplicates(none).collect() == [] == sharding.shard_documents(none).collect()
    assert packing.pack(packing.token_pieces(none, public_tokenizers.path("word_bpe_49k.json"))).collect() == []


def test_packing_against_the_library(spark, docs, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for i, text in rows:
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 2048):
            piece = ids[at : at + 2048]
            expected[i, at // 2048, at, len(piece), zlib.crc32(piece.tobytes()), piece.tobytes()] += 1
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    out = packing.pack(pieces).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.token_ids)) for r in out) == expected
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        ends = [0, *(o + n for o, n in sorted(held))]
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 2048
    assert len(places) == -(-sum(r.length for r in out) // 2048)  # no packing has fewer


def spans_by_hand(rows, keys):
    """{(id, text): [[first word, word after the last]]} of passages of 50 words that occur earlier."""
    seen, spans = set(), defaultdict(list)
    for i, text in sorted({(i, t) for i, t in rows if i is not None and t is not None}, key=lambda r: (r[0], keys[r[1]])):
        w = lowered(text)
        for k in range(len(w) - 49):
            gram = tuple(w[k : k + 50])
            if gram in seen:
                if spans[i, text] and k <= spans[i, text][-1][1]:
                    spans[i, text][-1][1] = k + 50
                else:
                    spans[i, text].append([k, k + 50])
            seen.add(gram)
    return spans


def cut_by_hand(rows, spans):
    left = Counter()
    for i, text in rows:
        places = [(m.start(), m.end()) for m in WORDS.finditer(text or "")]
        value, cut = text, spans.get((i, text), [])
        for low, high in reversed(cut):
            value = value[: places[low][0]] + value[places[high - 1][1] :]
        if not cut or value.strip():
            left[i, value.strip() if cut else value] += 1
    return left


def text_keys(docs):
    return {r.text: r.k for r in docs.select("text", F.xxhash64("text").alias("k")).collect()}


def test_repeats_of_one_id(spark, docs, rows):
    """Passages by brute force, with rows that repeat an id: in the order of id and of the texts' hashes."""
    spans = spans_by_hand(rows, text_keys(docs))
    expected = sorted((i, *s) for (i, _), found in spans.items() for s in found)
    assert sorted(tuple(r)[:3] for r in substrings.repeated_passages(docs).collect()) == expected and len(expected) >= 3
    assert Counter((r.doc_id, r.text) for r in substrings.without_repeats(docs).collect()) == cut_by_hand(rows, spans)


def test_token_files_roll_and_are_checked(spark, docs, rows):
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "t")
    tokenizer = Tokenizer.from_file(path)
    manifest = tokens.write_token_files(docs, folder, path, frame_bytes=1000, file_bytes=30_000, file_docs=7)
    assert manifest.count() > len({r.part for r in manifest.collect()}) and max(r.n_docs for r in manifest.collect()) <= 7
    out = tokens.read_token_files(spark, manifest, read_frames=3).orderBy("start").collect()
    expected = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.token_ids, "<u4").tolist())) for r in out) == expected
    start = 0
    for r, i in zip(out, sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i), strict=True):
        assert (r.doc_id, r.start) == (i, start)
        start += r.n_tokens
    file = max(manifest.collect(), key=lambda r: r.n_frames)
    fs, name = pafs.FileSystem.from_uri(file.path)
    with fs.open_input_file(name) as source:
        data = bytearray(source.read())
    for at in (20, len(data) - 2, len(data) - 40):  # a frame, the table's end, an entry of it
        spoilt = bytearray(data)
        spoilt[at] ^= 0xFF
        with fs.open_output_stream(f"{name}.bad", compression=None) as sink:
            sink.write(bytes(spoilt))
        with fs.open_input_file(f"{name}.bad") as source, pytest.raises((ValueError, EOFError, tokens.zstandard.ZstdError)):
            reader = tokens.TokenFileReader(source)
            for row in range(len(reader.doc_ids)):
                reader.ids(row)


def test_warc_finds_every_record(spark):
    member = warc.record(9, "http://in/side", b"x", None, False)  # a whole record inside a payload
    rnd = random.Random(1)
    url = "http://long/" + "".join(rnd.choices("abcdefgh0123456789", k=3 << 20))
    pages = [(1, url, "a"), (2, "http://b/", "".join(chr(b) for b in member)), (3, "c", "\x1f\x8b\x08 not a record"), (4, url, "b"), (4, "again", "c"), (None, None, None)]
    made = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("sha1", "refers_to", "r_id", "path", "low")}).coalesce(1)
    manifest = warc.write_warc(made, scratch(spark, "w"))
    out = warc.read_warc(spark, manifest, split_bytes=5000)
    ranges = sum(-(-r.bytes // 5000) for r in manifest.collect())
    assert out.rdd.getNumPartitions() == ranges > 100
    assert Counter((r.page_id, r.url, r.payload_bytes) for r in out.collect()) == Counter((i, u or "", len((h or "").encode())) for i, u, h in pages)
    fs, name = filesystem(manifest.first().path)
    with fs.open_input_file(name) as source:
        data = source.read()
    false = warc.GZIP_MAGIC + bytes(range(40))
    with fs.open_output_stream(f"{name}.2", compression=None) as sink:
        sink.write(false + data)
    with fs.open_input_file(f"{name}.2") as source:
        assert warc.first_record(source, 0, 1000) == len(false)
    spoilt = bytearray(data)
    spoilt[len(data) - 6] ^= 0xFF  # the last member's checksum
    with fs.open_output_stream(f"{name}.3", compression=None) as sink:
        sink.write(bytes(spoilt))
    with fs.open_input_file(f"{name}.3") as source, pytest.raises(Exception, match="(?i)incorrect|error"):
        at = 0
        while at < len(data):
            _, at = warc.read_record(source, at, False)


def test_media_features_by_hand(spark, docs, rows):
    folder = scratch(spark, "m")
    manifest = media.write_archives(docs, folder)
    stale = media.ArchiveWriter(*(lambda f: (f[0], f"{f[1]}/media-stale.tar"))(filesystem(folder)))
    stale.add("7/1.png", media.encode_image(bytes(64)))
    stale.close()  # of a lost attempt: not in the manifest
    out = media.media_features(media.read_archives(spark, folder, manifest)).collect()
    expected = Counter()
    for i, text in rows:
        raw = (text or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        mean = sum(data) / len(data)
        spread = math.sqrt(max(0.0, sum(b * b for b in data) / len(data) - mean * mean))
        step = sum(abs(a - b) for a, b in zip(data, data[1:], strict=False)) / (len(data) - 1)
        expected[i, len(raw), f"{mean:.4f} {spread:.4f} {step:.4f} " + " ".join(str(sum(32 * k <= b < 32 * k + 32 for b in data)) for k in range(8))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.feature) for r in out) == expected


@pytest.mark.parametrize(("percent", "least"), [(85, 0.999), (80, 0.999)])
def test_minima_behave_as_if_independent(percent, least):
    """Share of pairs of just this similarity that share a band and agree in enough minima."""
    rnd, found, n = np.random.default_rng(5), 0, 1500
    for _ in range(n):
        both = rnd.integers(0, 1 << 63, 2 * percent, dtype=np.uint64)
        own = rnd.integers(0, 1 << 63, 2 * (100 - percent), dtype=np.uint64)
        half = len(own) // 2
        grams = np.concatenate([both, own[:half], both, own[half:]])
        a, b = neardup.signatures(grams, np.asarray([0, len(both) + half, len(grams)]))
        same = a == b
        found += bool(same.reshape(neardup.BANDS, neardup.ROWS).all(axis=1).any() and same.sum() >= neardup.least_agreement(percent))
    assert found / n >= least


def test_scores_by_hand(spark):
    rnd = random.Random(2)
    texts = [(i, words_text(rnd, 30, 60) + (" vilest slurs" if i % 5 == 0 else ""), ("aa", "bb")[i % 2]) for i in range(400)]
    docs = spark.createDataFrame([*texts, (7, "another text of one id", "aa"), (9000, "", None), (None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(7, None), (99999, 1), (None, 1)], "doc_id long, toxic int")
    chain = toxicity.fit_chain(docs, labels)
    again = toxicity.fit_chain(docs.orderBy(F.desc("text")).repartition(7), labels.repartition(5))
    assert chain.threshold == again.threshold and [x.bias for x in chain.links] == [x.bias for x in again.links]
    assert chain.categories == ["toxic_aa", "toxic_bb", "toxic"]

    def plain(text):
        buckets, p = set(toxicity.text_features(text or "").tolist()), []
        for link in chain.links:
            z = link.bias + math.fsum(w for b, w in zip(link.buckets.tolist(), link.weights.tolist(), strict=True) if b in buckets) + sum(w * x for w, x in zip(link.before, p, strict=True))
            p.append(1 / (1 + math.exp(-max(-40, min(40, z)))))
        return p

    expected = sorted((i or -1, *(round(x, 9) for x in plain(t)), plain(t)[-1] >= chain.threshold) for i, t, *_ in docs.collect())
    out = sorted((r.doc_id or -1, *(round(r[f"p_{c}"], 9) for c in chain.categories), r.toxic) for r in toxicity.toxicity(docs, chain).collect())
    assert out == expected and 60 < sum(x[-1] for x in expected) < 100
    scorer = toxicity._Scorer(chain, remembered=10)
    assert all(abs(scorer(t)[-1] - plain(t)[-1]) < 1e-12 for _, t, _ in texts) and len(scorer.seen) <= 10 >= len(scorer.hits)


def test_licenses_against_whole_texts():
    """Blocks around hints give what one block of the whole text does."""
    rnd = random.Random(4)
    notices = [t for texts in licenses.TEMPLATES.values() for t in texts]
    quick, plain = licenses.Scanner(), licenses.Scanner()
    plain.blocks = lambda codes: iter([(0, len(codes))])
    found = planted = 0
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            w = rnd.choice(notices).split()
            for _ in range(rnd.choice([0, 0, 1])):
                w[rnd.randrange(len(w))] = "changed"
            planted += 1
            parts += [words_text(rnd, rnd.choice([0, 3, 150])), rnd.choice([" ", "\n", "\r\n * "]).join([" ".join(w[:3]), " ".join(w[3:])])]
        text = "\n".join([*parts, words_text(rnd, 5)])
        assert [*quick.find(text)] == [*plain.find(text)]
        found += len([*quick.find(text)])
    assert found >= 0.85 * planted


def test_checkpoint_folder_is_asked_for():
    class Session:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
