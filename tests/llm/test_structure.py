"""Filter interactions, best-fit packing and conversation repair, held against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import permutations, product

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("thermogrid.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from thermogrid.llm import audit, bestfit, conversations  # noqa: E402

DOCS = "doc_id long, text string, source string, part string, mask int, n long, quality int"


def _fails(text: str) -> set[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
    return out | ({"D"} if re.search("[#$%&*|]", text) else set())


def _audit(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    rows = []
    for doc_id, text, source in docs:
        text = text or ""
        bad = _fails(text)
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs):
            bad.add("E")
        rows.append((source or "", bad, any(i == doc_id and q == 1 for i, q, _ in labels if i is not None), any(i == doc_id and x == 1 for i, _, x in labels if i is not None)))
    out = []
    for part in {r[0] for r in rows}:
        removed_by = dict.fromkeys("ABCDE", 0)
        told = []
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                failing = [r for r in rows if r[0] == part and f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_by[f] += len(here)
                told.append((part, "".join(order), step, len(left), len(here), len(failing) - len(here), sum(r[1] == {f} for r in failing), sum(r[2] for r in here), sum(r[3] for r in here), f))
        out += [(*t[:-1], removed_by[t[-1]]) for t in told]
    return set(out)


def test_filter_interactions_equal_removal_in_every_order(spark):
    rng = random.Random(3)
    words = "alpha beta Gamma delta 12 # épée ABC".split()
    texts = [" ".join(rng.choice(words[: rng.randint(1, 8)]) + (str(rng.randint(0, 99)) if k % 3 else "") for _ in range(rng.choice([0, 3, 199, 200, 260]))) for k in range(24)]
    texts += ["", None, "\t\x0b \n", "Ünïcode ÄÖ", "x" * 300_000, "wort " * 70_000]
    docs = [(k, rng.choice(texts), rng.choice(["a", "b", None, ""])) for k in range(120)]
    docs += [docs[5], docs[5], (None, texts[0], "a"), (None, texts[0], "a"), (None, None, None), (-4, docs[7][1], "b"), (3, "other", "c")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    got = audit.filter_interactions(spark.createDataFrame([(*d, "clash", 7, 9, 1) for d in docs], DOCS), spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, part int"))
    assert [f"{n} {t}".replace("bigint", "long") for n, t in got.dtypes] == audit.SCHEMA.split(", ")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _audit(docs, labels)
    none = audit.filter_interactions(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 0


def test_removal_polynomial_shapley_and_corners():
    rng = random.Random(8)
    for n in (1, 3, 5):
        counts = [rng.randint(0, 50) for _ in range(1 << n)]
        p = audit.removal_polynomial(counts)
        corners = audit.at_corners(p)
        for s in range(1 << n):
            assert corners[s] == sum(c for m, c in enumerate(counts) if m & s)
            x = [0.25 + 0.5 * (s >> i & 1) for i in range(n)]  # inside the cube, too
            value = sum(c * np.prod([x[i] for i in range(n) if t >> i & 1]) for t, c in enumerate(p))
            assert value == pytest.approx(sum(c * (1 - np.prod([1 - x[i] for i in range(n) if m >> i & 1])) for m, c in enumerate(counts) if m))
        shares = [audit.shapley(p, i) for i in range(n)]
        assert sum(shares) == corners[-1]  # all that is removed, without a rest
        for i, share in enumerate(shares):
            marginal = [corners[b | 1 << i] - corners[b] for order in permutations(range(n)) for b in [sum(1 << k for k in order[: order.index(i)])]]
            assert share * len(marginal) == sum(marginal)


PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [" ", "  ", "\n", "\t", " \n ", " ", "　", "\u0085", "a", "Wort", "don't", " x", "123", "...", "<|endoftext|>", "<", "<|", "é", "漢字", "🙂", "\x1c", "\x00", "—", " ", "'s", "\r\n", "İ", "́", "²"]


def _ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_byte_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    rng, tokenizer = random.Random(5), Tokenizer.from_file(PATH)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x2000, 0x3100), 32])) for _ in range(20)) for _ in range(1000)] + [""]
    for encoder in (bestfit.ByteEncoder(PATH), bestfit.ByteEncoder(PATH)):
        for _ in range(2):  # with a cold and a warm cache
            ids, edges = encoder.encode(pa.array(texts, pa.string()))
            for t, a, b in zip(texts, edges[:-1], edges[1:], strict=True):
                assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    slow = bestfit.ByteEncoder(PATH)
    slow.quick = None
    again, _ = slow.encode(pa.array(texts, pa.string()))
    assert again.tolist() == ids.tolist()


def test_best_fit_takes_the_fullest_bin_that_holds_a_piece():
    rng = random.Random(2)
    fit, open_, made = bestfit.BestFit(100, 64, 5), {}, 100
    for _ in range(3000):
        n = rng.randint(1, 64)
        holding = [f for f in open_.values() if f >= n]
        sequence, offset = fit.place(n)
        if holding:
            assert 64 - offset == min(holding) == open_.pop(sequence)
        else:
            assert (sequence, offset) == (made, 0)
            made += 1
        if left := 64 - offset - n:
            if len(open_) == 5:
                fullest = min(open_.values())
                gone = [s for s, f in open_.items() if f == fullest and s not in fit.bins[f]]
                assert len(gone) == 1
                del open_[gone[0]]
            open_[sequence] = left
        assert sorted(open_) == sorted(s for stack in fit.bins for s in stack)


@pytest.mark.parametrize("pieces", [bestfit.PIECES, 40])
def test_best_fit_packing_is_whole(spark, pieces):
    from tokenizers import Tokenizer

    rng, tokenizer = random.Random(7), Tokenizer.from_file(PATH)
    texts = [" ".join(rng.choice("the cat sat on a mat Zebra! ünder 4711".split()) for _ in range(rng.choice([1, 20, 200, 700, 1022, 1023, 1024, 2047, 2048, 5000]))) for _ in range(60)]
    texts += ["long words " * 900_000, "", None, " \n "]  # the first is longer than a slice
    docs = [(k, t, "x", 3) for k, t in enumerate(texts)] + [(0, texts[0], "x", 3)] * 3 + [(None, texts[1], "x", 3)] * 2
    got = [r.asDict() for r in bestfit.pack_best_fit(spark.createDataFrame(docs, "doc_id long, text string, piece string, length int"), PATH, pieces=pieces).collect()]
    want = {}
    for doc_id, text, *_ in docs:
        ids = _ids(tokenizer, text)
        first = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            key = (doc_id, piece, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    have, bins = {}, {}
    for r in got:
        key = tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))
        have[key] = have.get(key, 0) + 1
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert have == want
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= sum(r["length"] for r in got) / 1024 * 1.1 + 2 * len(got) / pieces + 4
    assert bestfit.pack_best_fit(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def _brute(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """All edits of a short conversation, with at most two insertions in a row."""
    best = (10**9, "")
    choices = [["D"] if f not in ("", "truncated") else ["D", "R", "K"] for _, f in rows]
    for edits in product(*choices):
        for inserts in product(range(3), repeat=len(rows) + 1):
            audit_, cost, out, sure = "", 0, 0, 0
            for k in range(len(rows) + 1):
                cost += 2 * inserts[k]
                audit_ += "I" * inserts[k]
                out += inserts[k]
                if k == len(rows):
                    break
                role, fault = rows[k]
                audit_ += edits[k]
                if edits[k] == "D":
                    cost += 3
                    continue
                cost += (2 if edits[k] == "R" else 0) + (fault == "truncated")
                if edits[k] == "K":
                    if role == "s" and out == 0:
                        sure = 1
                    elif role != "ua"[(out - sure) % 2]:
                        cost = 10**9
                out += 1
            if (out - sure) % 2 == 0 and not (sure and out == 1):
                best = min(best, (cost, audit_))
    return best


def test_repair_equals_all_edits():
    rng = random.Random(11)
    for _ in range(250):
        rows = tuple((rng.choice("suauax") if rng.random() < 0.9 else "", rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 4)))
        assert conversations.repair(tuple((r if r in "sua" else "", f) for r, f in rows)) == _brute(list(rows)), rows


def test_streamed_conversation_equals_the_whole_chart():
    rng = random.Random(4)
    for n in (65, 200, 1500):
        whole, streamed = conversations.Chart(), conversations.Conversation()
        rows = [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(n)]
        for k, (role, fault) in enumerate(rows):
            whole.scan(role[:1], fault)
            streamed.add(k, role, f"t{k}", fault)
        cost, audit_ = whole.result()
        gaps, *_, got_cost, got_audit, _ = streamed.result()
        assert (got_cost, got_audit, gaps) == (cost, audit_, 0)
        assert n < 200 or len(streamed.audit[-1]) < n - 64  # the rest was handed out before


def _plain(rows: list[tuple], all_ids: set) -> dict:
    """The report of every conversation, from rows after the damage."""
    out = {}
    for conv in all_ids:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit_ = _brute([(r[2][:1], f) for r, f in zip(mine, faults, strict=True)]) if mine else (0, "")
        written, k, sure = [], 0, 0
        for edit in audit_:
            if edit == "I":
                role, text = "", ""
            else:
                role, text = mine[k][2:]
                k += 1
            if edit == "K" and not written and role[:1] == "s":
                sure = 1
            if edit in "IR":
                role = ["user", "assistant"][(len(written) - sure) % 2]
            if edit != "D":
                written.append(f"{role}:{text}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False)), cost, audit_, hashlib.sha256("\n".join(written).encode()).hexdigest(),
        )
    return out


def _damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, fault string, cost int"


def test_conversations_equal_plain_python(spark):
    rng = random.Random(6)
    rows = []
    for conv in [*range(150), None]:
        for turn in rng.sample([None, 0, 1, 2, 3, 9], rng.randint(1, 4)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "No! \t", "so", None, "", "\x0b\n", "Wirklich?", "a.b"])))
    lost = next(k for k in range(1000, 9999) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "gone."))  # nothing is left of it
    rows += [(7777, 0, "user", "Twice.")] * 2  # repeated rows
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA).repartition(5)
    told = conversations.repair_conversations(conversations.damaged(df))
    got = {r[0]: tuple(r)[1:] for r in told.collect()}
    assert told.count() == len(got)
    assert got == _plain(_damage(rows), {r[0] for r in rows})
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # without damage, and a column absent of another meaning is not needed
    plain = {r[0]: tuple(r)[1:] for r in conversations.repair_conversations(df).collect()}
    assert plain == _plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {r[0] for r in rows})
    assert conversations.repair_conversations(conversations.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_one_long_conversation_with_long_texts(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "word " * 2000 + "end.") for t in range(1200)]
    (r,) = conversations.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert r["audit"] == "K" * 1200 and r["cost"] == 0 and r["gaps"] == 0
    assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for _, _, a, b in rows).encode()).hexdigest()


def test_queries_travel_only_to_shelves_that_can_hold_better(spark):
    from thermogrid.llm import topk

    rng = np.random.default_rng(9)
    centres = rng.standard_normal((16, 14)) * 3
    v = np.floor(256 * (centres[np.arange(1600) % 16] + 0.1 * rng.standard_normal((1600, 14)))) / 256
    df = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    sent, plain = [], topk.promising

    def counted(asked, ends, portion):
        out = plain(asked, ends, portion)
        sent.append((out.count(), asked.count(), ends.select("dim", "shelf").distinct().count()))
        return out

    q = np.floor(256 * v).astype(np.int64)
    scores = q @ q.T
    want = set()
    for i in range(0, 1600, 50):
        best = sorted((-scores[i, j], j) for j in range(1600) if j != i)[:5]
        want |= {(i, k + 1, j, int(-s)) for k, (s, j) in enumerate(best)}
    try:
        for portion in (topk.PORTION, 40):  # all shelves at once, and a few at a time
            topk.promising = lambda asked, ends, portion=portion: counted(asked, ends, portion)
            assert {tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), block=16).collect()} == want
    finally:
        topk.promising = plain
    assert sent[0] == sent[1] and sent[0][0] < 0.5 * sent[0][1] * (sent[0][2] - 1)
    wide = np.array([[2**40, 2**40]])
    with pytest.raises(OverflowError):
        topk.products(wide, wide)


def _plain_label_model(votes, prior, start, groups, rounds):
    """EM over the groups' joint outcomes, one row at a time."""
    p = list(start)
    for _ in range(rounds):
        laws = []
        for g in groups:
            sums = [{}, {}]
            for row, q in zip(votes, p, strict=True):
                key = tuple(row[j] for j in g)
                for side, w in ((0, q), (1, 1 - q)):
                    sums[side][key] = sums[side].get(key, 0.0) + w
            n = 3 ** len(g)
            totals = [sum(p) + 0.5 * n, sum(1 - q for q in p) + 0.5 * n]
            laws.append(lambda key, sums=sums, totals=totals: [(s.get(key, 0.0) + 0.5) / t for s, t in zip(sums, totals, strict=True)])
        fresh = []
        for row, prior_one in zip(votes, prior, strict=True):
            yes, no = prior_one, 1 - prior_one
            for g, law in zip(groups, laws, strict=True):
                a, b = law(tuple(row[j] for j in g))
                yes, no = yes * a, no * b
            fresh.append(min(max(yes / (yes + no), 1e-4), 1 - 1e-4))
        p = fresh
    return p


def test_label_model_equals_plain_em_over_joint_outcomes():
    from thermogrid.llm import toxicity

    rng = np.random.default_rng(2)
    y = rng.random(400) < 0.3
    votes = np.column_stack([np.where(rng.random(400) < 0.3, 0, np.where(rng.random(400) < 0.85, np.where(y, 1, -1), np.where(y, -1, 1))) for _ in range(4)])
    votes = np.column_stack([votes, votes[:, 0]])  # a pair that goes together
    prior, start = np.full(400, 0.3), np.where((votes == 1).sum(1) > 1, 0.8, 0.2)

    def pairs(p):
        p = np.array(p)
        mean = [(votes * q[:, None]).sum(0) / q.sum() for q in (p, 1 - p)]
        return toxicity.paired(votes - p[:, None] * mean[0] - (1 - p[:, None]) * mean[1])

    for rounds in (3, 9):
        got, right, groups = toxicity.label_model(votes, prior, start, rounds)
        third = rounds // 3
        p = _plain_label_model(votes.tolist(), prior, np.clip(start, 0.02, 0.98), [(j,) for j in range(5)], third)
        for n in (third, rounds - 2 * third):  # pairs are looked for twice
            told = pairs(p)
            p = _plain_label_model(votes.tolist(), prior, p, told, n)
        assert told == groups and (0, 4) in groups and np.allclose(p, got, atol=1e-6)
        said = (votes != 0).sum(0)
        assert np.allclose(right, [sum(q if v == 1 else 1 - q for v, q in zip(votes[:, j], got, strict=True) if v) / said[j] for j in range(5)])


def test_scores_equal_a_plain_scorer(spark):
    from thermogrid.llm import toxicity
    from thermogrid.llm import words as W
    from thermogrid.llm.store import Workspace

    rng = random.Random(13)
    mild = [f"w{k}x" for k in range(400)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = [rng.choice(mild) for _ in range(rng.choice([10, 60, 300]))]
        for _ in range(rng.randint(2, 5) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["Nasty", "vile", "grimmer"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), Workspace(spark, "plain"))
    asked = [t for _, t in rows[:60]] + ["", "#$% &&", "NASTY VILE!! GRIMMER", "so so so so", "vile " + "word " * 400, "é Élan nastyé", "a" * 9000]
    got = model.score(pa.array(asked))
    for text, score in zip(asked, got, strict=True):
        data = text.encode()
        plain = [m.group() for m in re.finditer(rb"(?:[0-9A-Za-z]|[\x80-\xff])+", data)]
        seen = set()
        for kind, (hashes, column) in model.kinds.items():
            for w in plain:
                part = w[:kind] if kind else w
                if kind and len(w) <= kind:
                    continue
                one = W.Words(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]), np.array([0, 1]))
                h = int(toxicity.terms(W.Words(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), np.array([0, 1])), kind)[0][0]) if kind else int(one.hashes(toxicity._LOWERED)[0])
                seen |= {int(c) for x, c in zip(hashes.tolist(), column.tolist(), strict=True) if x == h}
        n, count = len(seen), len(plain)
        chance = n == 1 and count > toxicity.CHANCE
        loud = sum(len(w) > 2 and 65 <= w[0] <= 90 and 65 <= w[-1] <= 90 for w in plain) / max(count, 1)
        signs = min(sum(b in b"#$%&*|!<>{}" for b in data) / max(count, 1), 3)
        same = sum(a.lower() == b.lower() for a, b in zip(plain, plain[1:], strict=False)) / max(count, 1)
        z = 0.0 if chance else sum(model.weights[c] for c in seen)
        more = [n >= 1 and not chance, n >= 2, chance, 0.0 if chance else min(n / max(count / 100, 1), 3), loud, signs, same, count > 0]
        z += sum(w * float(v) for w, v in zip(model.weights[model.n_terms :], more, strict=True)) + model.bias
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-6), text[:40]
    assert got[62] > 0.5 > got[64]  # several terms, and a single one among many words


@pytest.mark.parametrize("size", [2, 3, 7])
def test_deep_nodes_equal_common_prefixes_of_all_suffixes(size):
    from thermogrid.llm.subtrees import deep_nodes

    rng = random.Random(size)
    for _ in range(30):
        texts = [[rng.choice("ab" if size < 7 else "a") + ("" if rng.random() < 0.95 else "x") for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(0, 5))]
        flat = [w for t in texts for w in t]
        h = np.array([hash(w) & 0xFFFFFFFF for w in flat], np.uint64)
        room = np.array([len(t) - k for t in texts for k in range(len(t))], np.int64)
        suffix = [t[k:] for t in texts for k in range(len(t))]
        want = {}
        for k, s in enumerate(suffix):
            if len(s) >= size:
                want.setdefault(tuple(s[:size]), []).append(k)
        want = {key: v for key, v in want.items() if len(v) > 1}
        got = deep_nodes(h, room, size)
        parts = np.split(got.leaves, got.begin[1:]) if len(got.begin) else []
        assert sorted(sorted(p.tolist()) for p in parts) == sorted(want.values())
        for part, depth in zip(parts, got.depth.tolist(), strict=True):
            shared = 0
            while all(len(suffix[k]) > shared and suffix[k][shared] == suffix[part[0]][shared] for k in part):
                shared += 1
            assert depth == shared >= size
