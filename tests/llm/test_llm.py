"""Every operator against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", score double, name string, bucket int, key long"


def words(rng, n):
    return [rng.choice("abcdefgh") + rng.choice("xyzuvw") + str(rng.randint(0, 99)) for _ in range(n)]


def corpus(seed=3):
    rng = random.Random(seed)
    passage = " ".join(words(rng, 70))
    base = words(rng, 120)
    texts = ["", None, "One", "ONE", "one", "Été", "été", " ", "x" * 9000, "X" * 9000, "x" * 9001]
    texts += [" ".join(words(rng, 30)) + " " + passage + "\n" + " ".join(words(rng, 20)) for _ in range(6)]
    for k in range(8):
        copy = list(base)
        copy[10 * k + 5] = f"changed{k}"
        texts.append(" ".join(copy))
    texts += [" ".join(words(rng, rng.randint(1, 200))) for _ in range(20)]
    texts += ["Licensed under the Apache License, Version 2.0. More here.\nAll rights reserved"] * 3
    return list(enumerate(texts)) + [(len(texts) - 1, texts[-1]), (None, "one"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, 0.5, "n", 1, 2) for i, t in corpus()]
    return spark.createDataFrame(rows, DOCS + EXTRA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS + EXTRA)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact(docs, none):
    from thermogrid.llm.exact import exact_duplicates

    rows = corpus()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = collections.Counter()
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        keep = max(ids) if ids else None
        want[i, keep, len(groups[lower(t)]), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()] += 1
    for block in (4096, 7):
        assert collections.Counter(map(tuple, exact_duplicates(docs, block).collect())) == want
    assert exact_duplicates(none).count() == 0


def test_exact_with_a_heavy_key(spark):
    from thermogrid.llm.exact import exact_duplicates

    rows = [(i, "same long text" * 3 if i % 2 else f"own {i} text") for i in range(400)]
    got = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert {r["group_size"] for r in got} == {1, 200} and {r["keep_id"] for r in got if r["group_size"] == 200} == {399}


def similarity(a, b):
    def bag(t):
        w = (t or "").split()
        return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_near(docs, none):
    from thermogrid.llm.dartminhash import near_duplicates

    got = {r["doc_id"]: r for r in near_duplicates(docs).collect() if r["doc_id"] is not None}
    rows = [r for r in corpus() if r[0] is not None]
    root = {i: i for i, _ in rows}
    for a, (i, t) in enumerate(rows):
        for j, u in rows[:a]:
            if (t or "") == (u or "") or similarity(t, u) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert {i: r["class_id"] for i, r in got.items()} == root
    assert near_duplicates(docs).count() == docs.count() and near_duplicates(none).count() == 0


@pytest.mark.parametrize("sizes", [(128, 256), (3, 5)])
def test_near_chains_and_links_away_from_the_centre(spark, monkeypatch, sizes):
    """Families in which many linked pairs do not link to the most frequent member of their buckets."""
    from thermogrid.llm import dartminhash as D

    monkeypatch.setattr(D, "OUTER", sizes[0])
    monkeypatch.setattr(D, "INNER", sizes[1])
    rng, texts = random.Random(11), []
    for _ in range(12):
        base = words(rng, 120)
        family = [base]
        for _ in range(9):  # each a small change of some earlier member
            t = list(rng.choice(family[-3:]))
            for _ in range(rng.choice((2, 2, 3))):
                t[rng.randrange(len(t))] = f"new{rng.random()}"
            family.append(t)
        texts += [" ".join(t) for t in family]
    rows = list(enumerate(texts))
    root = {i: i for i, _ in rows}
    for i, t in rows:
        for j, u in rows[:i]:
            if root[i] != root[j] and similarity(t, u) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in D.near_duplicates(df).collect()}
    assert got == root and len(set(root.values())) > 12


def test_near_groups_write_rows_in_proportion(spark, monkeypatch):
    """In a group whose pairs all are a little below the similarity, pairs and links are no more rows than texts; links across it count."""
    from thermogrid.llm import dartminhash as D
    from thermogrid.llm.store import Workspace

    keep, tables = Workspace.keep, []
    monkeypatch.setattr(Workspace, "keep", lambda self, df, tag: tables.append((tag, keep(self, df, tag))) or tables[-1][1])
    rng, texts = random.Random(12), []
    base = words(rng, 600)
    for k in range(60):
        t = list(base)
        for c in rng.sample(range(0, 600, 5), 8):
            t[c] = f"new{k}-{c}"
        texts.append(" ".join(t))
        if k % 3 == 0:
            t[157] = "other"
            texts.append(" ".join(t))
    root = {i: i for i in range(len(texts))}
    for i, t in enumerate(texts):
        for j, u in enumerate(texts[:i]):
            if root[i] != root[j] and similarity(t, u) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    got = {r["doc_id"]: r["class_id"] for r in D.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == root and 20 < len(set(root.values())) < len(texts)
    rows = lambda tag: sum(spark.read.schema(df.schema).parquet(*df.inputFiles()).count() for t, df in tables if t.startswith(tag) and df.inputFiles())
    assert rows("found") <= len(texts) and rows("links") <= 2 * (rows("edges") + rows("found"))


def test_near_repeated_rows_and_null_ids(spark):
    from thermogrid.llm.dartminhash import near_duplicates

    rng = random.Random(8)
    base = words(rng, 100)
    near = " ".join([*base[:50], "changed", *base[51:]])
    rows = [(None, " ".join(base)), (None, near), (None, near), (3, "alone " + " ".join(words(rng, 20)))] + [(7, near + " more")] * 20
    got = near_duplicates(spark.createDataFrame(rows[:4], "doc_id long, text string")).collect()
    assert sorted((r["class_id"] or 0, r["class_size"], r["kept"]) for r in got) == [(0, 3, True)] * 3 + [(3, 1, True)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == {(None, 7, 23): 3, (3, 3, 1): 1, (7, 7, 23): 20}


def test_open_buckets_lose_no_pair(spark, monkeypatch):
    from thermogrid.llm import dartminhash as D

    monkeypatch.setattr(D, "OUTER", 3)
    monkeypatch.setattr(D, "INNER", 5)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, 120)
    sketch = {i: np.where(rng.random(120) < 0.12, rng.integers(0, 256, 120), base).astype(np.uint8) for i in range(40)}
    root = {i: 0 if i < 25 else 25 if i < 35 else i for i in range(40)}
    bands = {7: range(40), 8: range(20), 9: range(30, 40), 10: [3, 36]}
    members = spark.createDataFrame([(b, i) for b, m in bands.items() for i in m], "band long, rep long")
    own = lambda i: [b if i in m else -(100 * b + i) for b, m in bands.items()]
    texts = spark.createDataFrame([(i, 100 + i, bytearray(sketch[i].tobytes()), own(i)) for i in sketch], "rep long, n long, sketch binary, bands array<long>")
    roots = spark.createDataFrame(list(root.items()), "node long, root long")
    least = 96 - D.DEVIATIONS * (120 * 0.16) ** 0.5
    agree = lambda a, b: (sketch[a] == sketch[b]).sum()
    want = {(a, b) for a in sketch for b in sketch if a < b and root[a] != root[b] and agree(a, b) >= least and 100 + a >= 0.8 * (100 + b)}
    got = D._open_pairs(members, texts, roots, 0.8, 1000).collect()
    assert want and {(r["a"], r["b"]) for r in got} == want and not any(r["cut"] for r in got)
    got = D._open_pairs(members, texts, roots, 0.8, 1).collect()
    some = {(r["a"], r["b"]) for r in got}
    assert any(r["cut"] for r in got)
    assert some < want and {i for p in some for i in p} >= {b for _, b in want if b >= 35}


def test_dart_signatures_estimate_weighted_similarity():
    from thermogrid.llm.dartminhash import dart_minhash

    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (300, 100, 100))
    elements, owner = np.concatenate([shared, a, shared, b]), np.repeat([0, 1], 400)
    sign = dart_minhash(elements, owner, 3, 1024)
    assert abs((sign[0] == sign[1]).mean() - 0.6) < 0.06 and not sign[2].any()
    half = np.concatenate([np.ones(400), np.full(300, 0.5), np.zeros(100)])  # min/max: 150 / 400
    sign = dart_minhash(elements, owner, 2, 1024, half)
    assert abs((sign[0] == sign[1]).mean() - 150 / 400) < 0.06


@pytest.mark.parametrize("group", [1000, 8, 2])
def test_substring(docs, none, group):
    from thermogrid.llm.substring import remove_repeats, repeated_spans, substring_report, without_repeats

    first, want = {}, collections.Counter()
    order = lambda i: 2**62 if i is None else i
    for i, t in corpus():
        w = (t or "").split()
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            first[x] = min(first.get(x, 2**62), order(i))
    kept_of = {}
    for i, t in corpus():
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < order(i):
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        kept_of[i] = kept if gone else t
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert sum(k[2] for k in want) > 200
    if group == 1000:
        assert collections.Counter(map(tuple, substring_report(docs).collect())) == want
        assert {r["doc_id"]: r["text"] for r in remove_repeats(docs).filter("doc_id IS NOT NULL").collect()} == {i: t for i, t in kept_of.items() if i is not None}
        assert substring_report(none).count() == 0
    else:  # all prefixes count as long ones
        _, lost = without_repeats(docs, group=group)
        assert {(r["doc_id"], r["n_removed"]) for r in lost.collect()} == {(k[0], k[2]) for k in want if k[2]}
    assert repeated_spans


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    from thermogrid.llm.packing import pack_documents

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(2)
    extra = [(1000 + k, " ".join(words(rng, rng.choice((3, 40, 300, 900, 2000))))) for k in range(60)] + [(2000, "word, " * 60_000)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).coalesce(2)
    rows = pack_documents(df, path).collect()
    want = collections.Counter()
    for i, x in [*corpus(), *extra]:
        want[i, np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()] += 1
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for (i, ids), times in want.items():
        n, at = len(ids) // 4, 0
        same = [k for k in want if k[0] == i and len(k[1]) == len(ids)]
        for start, length, crc in sorted(pieces[i, n]) if times == 1 and len(same) == 1 else []:
            assert start == at and crc == zlib.crc32(ids[4 * at : 4 * (at + length)])
            at += length
        assert at in (0, n) and sum(x[1] for x in pieces[i, n]) == sum(want[k] for k in same) * n
    assert sum(r["length"] for r in rows) == sum(n * len(ids) // 4 for (_, ids), n in want.items())
    for _, own in sequences(rows).items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    assert len(rows) < 2.2 * df.count()
    assert pack_documents(none, path).count() == 0


def test_bins_take_a_fixed_number_of_documents():
    from thermogrid.llm.packing import Packer

    packer = Packer(0, 100)
    for k in range(40):
        packer.add(k, bytes(4 * 30))
    length, sequence = packer.out[2], packer.out[5]
    full = collections.Counter(sequence)
    assert full and min(full.values()) == 4  # three whole documents of class 3 and a head; the tails go to smaller classes
    assert all(sum(n for n, s in zip(length, sequence, strict=True) if s == q) == 100 for q in full)
    packer.close()
    assert sum(packer.out[2]) == 40 * 30


def sequences(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r["sequence_id"]].append((r["offset"], r["length"]))
    return out


def test_word_encoder_equals_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    from thermogrid.llm import packing

    path = P.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = ["Don't STOP, it's 3rd!!", "é É ß Σας ΟΔΟΣ", "a b c\x1fd", "<|endoftext|> x<|startoftext|>y", "''s 'S ''''re 'select", "日本語 テスト", "", None, "🙂🙂 ok", "İi ²³½ ªº1²3 é x y z", " \t\n"]
    texts += [f"a{chr(c)}B{chr(c)} {chr(c)}" for c in range(1, 0x3000)]
    for most in (packing.CACHE, 50):
        monkeypatch.setattr(packing, "CACHE", most)
        for _ in range(2):
            ids, at = e.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_pieces(docs, none):
    import sentencepiece

    from thermogrid.llm.piece_codec import SegmentEncoder, encode_documents

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in encode_documents(docs, path).filter("doc_id IS NOT NULL").collect():
        text = dict(corpus())[r["doc_id"]] or ""
        ids = sp.encode(text)
        assert (r["n_ids"], r["ids_crc32"], r["round_trip"]) == (len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), True)
    e = SegmentEncoder(path)
    for x in ["  a   b ", " ", "a\n b\t", "▁ q", "é́ Ⅳ  "]:
        assert e.encode(x) == np.asarray(sp.encode(x), "<u4").tobytes()
    assert encode_documents(none, path).count() == 0


def best_sum(text, pieces):
    """The largest sum over all segmentations, by plain recursion from the left."""
    from thermogrid.llm.piece_codec import marked

    text = marked(text)
    best = [0.0] + [-1e300] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - pieces.longest), j):
            s = pieces.score.get(text[i:j], pieces.unknown if j == i + 1 else -1e300)
            best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_max_plus_scan_against_all_segmentations(spark):
    from thermogrid.llm.piece_codec import Pieces, combine, encode_unigram, encode_unigram_documents

    path = P.path("piece_bpe_32k.model")
    pieces = Pieces(path)
    total = lambda ids: sum(pieces.score.get(pieces.piece[i], 0) for i in ids)
    text = "Thorreou ndernt, threa by for and the threea." * 3
    for chunk in (5, 17, 64, 10**9):  # a piece may span several chunks
        got = encode_unigram(text, pieces, chunk)
        assert pieces.decode(got) == text and abs(total(got) - best_sum(text, pieces)) < 1e-6
    odd = "é\u0142 日本語 🙂 the"
    assert pieces.decode(encode_unigram(odd, pieces, 4)) == odd
    a, b, c = np.random.default_rng(0).standard_normal((3, 4, 4))
    assert np.allclose(combine(combine(a, b), c), combine(a, combine(b, c)))
    rows = [(1, text), (2, text * 20), (2, ""), (3, None), (None, "the of"), (4, odd)]
    got = collections.defaultdict(dict)
    for r in encode_unigram_documents(spark.createDataFrame(rows, "doc_id long, text string"), path, chunk=40, group=3).collect():
        got[r["doc_id"]][r["chunk"]] = r["ids"]
    joined = {i: [x for k in sorted(parts) for x in parts[k]] for i, parts in got.items()}
    assert set(joined) == {1, 2, 4, None} and len(got[2]) > 60
    for i, t in ((1, text), (2, text * 20), (None, "the of"), (4, odd)):
        assert pieces.decode(joined[i]) == t and (i == 4 or abs(total(joined[i]) - best_sum(t, pieces)) < 1e-6)
    assert encode_unigram_documents(spark.createDataFrame(rows[:0], "doc_id long, text string"), path).count() == 0


def test_top_k(spark):
    from thermogrid.llm.topk import top_k

    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.25, 1.0]) for _ in range(4)], 0) for i in range(200)]
    rows += [(200, None, 0), (250, [1.0, None, 0.0, 0.0], 0), (300, [float("nan")] * 4, 0), (350, [float("inf"), 0.0, 0.0, 0.0], 0), (400, [1.0, 2.0], 0), (None, [1.0] * 4, 0), (7, rows[7][1], 0), (450, [], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    good = [(i, [int(np.floor(256 * x)) for x in e]) for i, e, _ in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    want = set()
    for q, e in good:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(e, f, strict=True)), i) for i, f in good if i != q and len(e) == len(f))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:5])}
    for block in (256, 16, 3):
        assert set(map(tuple, top_k(v, v.filter("vec_id % 50 = 0"), block=block).collect())) == want
    assert top_k(v.limit(0), v.limit(0)).count() == 0


def test_bounds_leave_out_blocks_of_other_directions():
    from thermogrid.llm.topk import Shelf

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16)) * 100
    block = np.repeat(np.arange(20), 50)
    rows = np.floor(centres[block] + rng.standard_normal((1000, 16)) * 10).astype(np.int64)
    ids = rng.permutation(1000)
    shelf = Shelf(ids, rows, block)
    at = np.arange(0, 1000, 25)
    i, found, score = shelf.search(rows[at], ids[at], np.full(len(at), -(1 << 62)), 5)
    all_scores = rows[at] @ rows.T
    for q in range(len(at)):
        want = sorted((-all_scores[q, j], ids[j]) for j in range(1000) if j != at[q])[:5]
        assert [(-s, d) for s, d in zip(score[i == q].tolist(), found[i == q].tolist(), strict=True)] == want
    assert shelf.scored < 0.5 * shelf.pairs


def test_warc(spark, tmp_path):
    from thermogrid.llm import warc

    long = "<p>" + "é" * 200
    rows = [(5, "http://a", long, 1), (3, "http://b", long, 1), (9, None, long, 1), (3, "http://b", long, 1), (1, "u", "short", 1), (2, "u", "short", 1), (4, "u", None, 1), (None, "u", long, 1), (6, "u\r\nX: y", "", 1)]
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.through_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest int")).collect())
    want = collections.Counter()
    for i, _, h, _ in rows:
        b = (h or "").encode()
        other = len(b) >= 100 and i != 3
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if other else "response", 3 if other else None] += 1
    assert got == want
    assert warc.through_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    import zstandard

    good = warc.record("response", 1, "u", b"body", hashlib.sha256(b"body").hexdigest(), None)
    trained = warc.dictionary([bytes(words_for(k)) for k in range(400)])
    packed = warc.start(trained) + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained)).compress(good) + warc.SEPARATOR.encode()
    assert trained and [warc.parse(x)["payload"] for x in warc.frames(packed)] == [b"body"]
    for bad in (packed[: len(packed) - 12], packed + b"junk", packed + b"notaframe123"):
        with pytest.raises(warc.WarcError):
            list(warc.frames(bad))
    for bad in (good[:-1], good.replace(b"body", b"bodi"), good.replace(b"WARC/1.1", b"WARK/1.1"), good.replace(b"Content-Length: 4", b"Content-Length: 5")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_frames_of_a_large_archive_are_found_by_their_blocks():
    import zstandard

    from thermogrid.llm import warc

    rng = random.Random(4)
    payloads = [rng.randbytes(rng.choice((0, 1, 500, 3000))) for _ in range(3000)] + [b"a" * 3_000_000, rng.randbytes(400_000)]
    plain = [warc.record("response", k, "u", x, hashlib.sha256(x).hexdigest(), None) for k, x in enumerate(payloads)]
    for packer in (zstandard.ZstdCompressor(write_checksum=True), zstandard.ZstdCompressor(write_content_size=False)):
        archive = b"".join(packer.compress(x) for x in plain)
        assert list(warc.frames(archive)) == plain
        with pytest.raises(warc.WarcError):
            list(warc.frames(archive[:-1]))


def words_for(k):
    return (f"<html><body class='page'>{k} " + " ".join(words(random.Random(k), 60))).encode()


def test_licences(docs, none):
    from thermogrid.llm.licences import licences

    got = {r["doc_id"]: (r["n_sentences"], r["sentence_ids"], r["licences"]) for r in licences(docs).collect()}
    last = max(i for i, _ in corpus() if i is not None)
    assert got[last] == (3, "apache-2-ref all-rights", "Apache-2.0") and got[0] == got[1] == (0, "", "")
    assert licences(none).count() == 0


HEADERS = {
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "BSD-3-Clause": """/*
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 *
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
 *
 * 3. Neither the name of Example Inc. nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
 */""",
    "GPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "LGPL-2.1-or-later": """// This library is free software; you can redistribute it and/or
// modify it under the terms of the GNU Lesser General Public
// License as published by the Free Software Foundation; either
// version 2.1 of the License, or (at your option) any later version.""",
    "MPL-2.0": """-- This Source Code Form is subject to the terms of the Mozilla Public
-- License, v. 2.0. If a copy of the MPL was not distributed with this
-- file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Apache-2.0 MIT": "// SPDX-License-Identifier: (MIT OR Apache-2.0)",
    "GPL-2.0-or-later": "/* SPDX-License-Identifier: GPL-2.0+ */",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
    "": "This work is not licensed under the MIT License; or Apache-2.0, and licences vary.",
}


def test_licence_headers_as_they_are_written(spark):
    from thermogrid.llm.licences import licences

    names = list(HEADERS)
    docs = spark.createDataFrame([(i, f"x = 1\n{HEADERS[n]}\n\ny = 2\n") for i, n in enumerate(names)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences(docs).collect()}
    assert {n: " ".join(sorted(got[i].split())) for i, n in enumerate(names)} == {n: n for n in names}


def test_licence_sentence_with_much_padding(spark):
    from thermogrid.llm.licences import licences

    text = "Released" + " " * 300 + "under the" + "\t" * 200 + "MIT License." + "\n" + " " * 500 + "All rights reserved."
    row = licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["sentence_ids"] == "mit-ref all-rights" and row["licences"] == "MIT"


def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad, junk = i % 5 == 0, i % 3 == 0
        w = words(rng, 60)
        if bad:
            w[7], w[9] = "vilestem" + rng.choice("abcdef"), "nasty"
        t = " ".join(f"{x}###" for x in w) if junk else " ".join(w)
        rows.append((i, t, 1.0))
        labels.append((i, int(not junk), int(bad)))
    rows += [(600, None, 1.0), (601, "", 1.0), (601, "", 1.0), (None, "nasty", 1.0)]
    labels += [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_classifiers(spark, which):
    from thermogrid.llm.quality import score_quality
    from thermogrid.llm.toxicity import score_toxicity

    docs, labels = labelled(spark)
    score = score_toxicity if which == "toxic" else score_quality
    got = score(docs, labels)
    assert got.count() == docs.count() and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    j = got.join(labels.filter(f"{which} IS NOT NULL"), "doc_id").filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0")
    assert j.filter(f"predicted = {which}").count() >= 0.95 * j.count() > 50
    assert score(docs, labels.limit(0)).count() == docs.count() and score(docs.limit(0), labels).count() == 0


def test_symbols_count_for_their_own_text():
    from thermogrid.llm import words as W
    from thermogrid.llm.toxicity import patterns

    texts = ["calm words here", "$$$ %% one two", None, "", "###", "end #", "!!"]
    each = [patterns(W.split(pa.array([t], pa.string()), W.NOT_WORD), 1)[0].tolist() for t in texts]
    assert [p[1] for p in each] == [0, 2.5, 0, 0, 3, 1, 2]
    assert patterns(W.split(pa.array(texts), W.NOT_WORD), len(texts)).tolist() == each
    back = patterns(W.split(pa.array(["x", *texts[::-1]]).slice(1), W.NOT_WORD), len(texts))
    assert back.tolist() == each[::-1]


def test_slices_cover_every_row():
    from thermogrid.llm.words import slices

    column = pa.array(["a" * n for n in (0, 5, 100, 3)] + [None])
    assert [x for a, b in slices(column, 10, 2) for x in range(a, b)] == list(range(5))


def test_label_model_finds_planted_accuracies_and_pairs():
    from thermogrid.llm.toxicity import label_model

    rng = np.random.default_rng(9)
    y = rng.random(6000) < 0.3
    accuracy = [0.9, 0.8, 0.75, 0.7, 0.85]
    votes = np.stack([np.where(rng.random(len(y)) < 0.7, np.where(rng.random(len(y)) < a, 1, -1) * np.where(y, 1, -1), 0) for a in accuracy], axis=1)
    copy = np.where(rng.random(len(y)) < 0.9, votes[:, 3], 0)  # a voter that repeats another one
    votes = np.column_stack([votes, copy])
    p, right, groups = label_model(votes, np.full(len(y), 0.3), np.where((votes == 1).sum(1) > (votes == -1).sum(1), 0.8, 0.2))
    assert np.abs(right[:5] - accuracy).max() < 0.05 and (3, 5) in groups
    exact = np.full(len(y), np.log(0.3 / 0.7))
    for j, a in enumerate(accuracy):
        exact += votes[:, j] * np.log(a / (1 - a))
    assert ((p > 0.5) == (exact > 0)).mean() > 0.97


def test_quality_votes_against_all_cosines():
    from thermogrid.llm.quality import TERMS, Model, counts, unit

    rng = np.random.default_rng(6)
    made = random.Random(1)
    texts = pa.array([" ".join(words(made, made.randint(1, 60))) for _ in range(40)] + ["", None, "### !! ##"])
    model = Model(rng.random(TERMS).astype(np.float32), rng.standard_normal((TERMS, 8)).astype(np.float32), unit(rng.standard_normal((90, 8)).astype(np.float32)), (rng.random(90) < 0.4).astype(np.float32), np.where(rng.random(90) < 0.5, 0.5, 2.0).astype(np.float32))
    got, x = model.score(texts, 7), counts(texts)
    for i in range(len(texts)):
        v = x[i] * model.weights
        v = v / max(np.linalg.norm(v), 1e-9) @ model.axes
        v = v / max(np.linalg.norm(v), 1e-9)
        cosine = [float(v @ u) for u in model.vectors]
        near = sorted(range(90), key=lambda k: -cosine[k])[:7]
        weight = [max(cosine[k], 1e-3) ** 4 * model.votes[k] for k in near]
        assert abs(got[i] - sum(w * model.labels[k] for w, k in zip(weight, near, strict=True)) / sum(weight)) < 1e-3
