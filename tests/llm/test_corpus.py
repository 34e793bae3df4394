"""Corpus operators on small tables, against brute force, round trips and held-out labels."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ndspark.llm import bpe, chat, fingerprint, neardup, packing, quality, secrets, sharding, topk, toxicity
from ndspark.llm.common import in_fold, labelled_sample

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LONG = "word and more words, " * 4000
AWKWARD = [(0, "plain text of some words"), (1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "plain text of some words"), (5, "plain text of some words"), (None, "no id here"), (7, "ünïcödé 漢字 😀 \x00 text"), (8, "x")]


@pytest.fixture
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those of operators."""
    rows = [(k, t, "en", 1, "a", 2.0) for k, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, size string, score double")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n int, size string, score double")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# -- 1 secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secret_tokens_with_a_late_digit(spark):
    token = "wJalrXUtnFEMIKMDENGbPxRfiCYEXAMPLEKEY7a9"
    docs = frame(spark, [f"user: bob {token}"])
    r = secrets.secrets(docs).first()
    assert (r.spans, r.n_linked) == ("account:0:9,token:10:50", 2)
    assert token not in secrets.redact(docs).first().text


def test_secrets_against_patterns(spark):
    rng = random.Random(3)
    bits = ["token", "API_KEY", "apikey", "Password", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH1234567890", "deadbeef" * 3, "é", "x.y", "\n", "secret=", "passwd : zzzzzz"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    for r in secrets.secrets(frame(spark, texts)).collect():
        base = plain_spans(texts[r.doc_id])
        kept = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex"))
        assert kept == base and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.n_assign + r.n_access + r.n_hex == len([x for x in base.split(",") if x])


def test_weak_parts_need_a_complement(spark):
    mixed = "aB3dE5gH7jK9mN1pQ3sT5"
    texts = [f"user: bob and {mixed}", mixed, "user: bob", f"user: bob {'. ' * 300}{mixed}", f"https://db.example.org/x key {mixed}"]
    linked = {r.doc_id: r.spans for r in secrets.secrets(frame(spark, texts)).collect()}
    assert linked == {0: "account:0:9,token:14:35", 1: "", 2: "", 3: "", 4: "endpoint:0:24,token:29:50"}


def test_many_parts_link_once(spark):
    text = " ".join(f"user: bob{k} aB3dE5gH7jK9mN1pQ3s{k:03d}" for k in range(300))
    r = secrets.secrets(frame(spark, [text])).first()
    assert r.n_linked == 600 and len(r.spans.split(",")) == 600


def test_redact(spark, awkward):
    masked = secrets.redact(frame(spark, ["my token = abcdef12 here", None, ""]).withColumn("n_chars", F.lit(1).cast("long"))).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in masked] == [("my [SECRET] here", 16), (None, None), ("", 0)]
    assert secrets.redact(awkward).count() == len(AWKWARD)
    assert sorted(map(str, secrets.redact(awkward).select("doc_id", "text").collect())) == sorted(map(str, awkward.select("doc_id", "text").collect()))


@pytest.mark.parametrize("few", [100_000, 0])
def test_redact_hides_linked_parts_everywhere(spark, few, monkeypatch):
    monkeypatch.setattr(secrets, "BROADCAST_TEXTS", few)
    token = "Zx9" + "aB3dE5" * 5
    texts = [f"login: alice99 then {token} at the end", f"nothing but {token} here", "login: alice99 and no more"] * 40
    rows = secrets.redact(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    assert {r.text for r in rows if r.doc_id % 3 == 0} == {"[SECRET] then [SECRET] at the end"}
    assert all(r.text == texts[r.doc_id] for r in rows if r.doc_id % 3)


# -- 2 sharding


def test_shards(spark, awkward, nothing, tmp_path):
    docs = frame(spark, ["x" * (k % 97) for k in range(3000)]).unionByName(awkward.select("doc_id", "text"))
    rows = sharding.shard(docs, 24, map_path=str(tmp_path / "maps")).collect()
    assert len(rows) == 3000 + len(AWKWARD)
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) <= 1.05 * sum(loads.values()) / 24 + LONG.__len__()
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.edited_shard in (r.shard, 24) for r in rows) and any(r.edited_shard == 24 for r in rows)
    assert {r.text_crc32 for r in rows if r.doc_id == 1 and r.size == 8} >= {0}
    maps = [sharding.SlotMap.load(spark, str(tmp_path / "maps"), v) for v in (1, 2)]
    assert maps[0].grown() == maps[1]
    with pytest.raises(Exception):
        maps[0].save(spark, str(tmp_path / "maps"))
    assert sharding.shard(nothing).count() == 0


def test_shards_by_row(spark, awkward):
    """Sizes, checksums, slots, places and shards against a plain computation."""
    texts = [("é" * (k % 13) + "x" * (k * 7 % 200)) if k % 11 else None for k in range(500)]
    docs = frame(spark, texts).unionByName(awkward.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    of = [*enumerate(texts), *((None if k is None else k + 1000, t) for k, t in AWKWARD)]
    rows = sharding.shard(docs, 24).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((k, len(raw(t)) + 8, zlib.crc32(raw(t))) for k, t in of)
    n_rows, n_bytes = [0] * 4096, [0] * 4096
    for r in rows:
        n_rows[r.vslot] += 1
        n_bytes[r.vslot] += r.size
    first = sharding.SlotMap.balanced(n_rows, n_bytes, 24)
    assert all((r.shard, r.edited_shard) == (first.shard_of[r.vslot], first.grown().shard_of[r.vslot]) for r in rows)
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) and max(Counter((r.doc_id, r.text_crc32, r.vslot) for r in rows).values()) == 2


def test_links_against_all_pairs(spark):
    """Linked parts of random texts against a comparison of all parts of a text."""
    rng = random.Random(12)
    bits = ["user: bob7 ", "aB3dE5gH7jK9mN1pQ3sT5 ", "https://h.example/a ", "token = abcdef99 ", "AKIA" + "Z9" * 10 + " ", "f0" * 13 + " ", "plain words here " * 4, ". " * 60, "10.0.0.1:8080 "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    for r in secrets.secrets(frame(spark, texts)).collect():
        strong = secrets.base_spans(texts[r.doc_id])
        parts = [*strong, *secrets.weak_parts(texts[r.doc_id], strong)]
        near = lambda a, b: a[0] <= b[2] + 200 and b[0] <= a[2] + 200
        linked = [p for p in parts if p[1] > 2 and any((p[1] in (0, 2, 4)) != (o[1] in (0, 2, 4)) and near(p, o) for o in parts)]
        assert r.n_linked == len(linked) and r.spans == secrets.joined(sorted([*strong, *linked]))


def test_weak_parts_inside_findings():
    rng = random.Random(13)
    bits = ["user: bob7 ", "aB3dE5gH7jK9mN1pQ3sT5", "https://h.example/a ", "token = ", "token=user:", "f0" * 13, " ", "f0A" * 9, "10.0.0.1:8080 "]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        strong = secrets.base_spans(text)
        every = secrets.weak_parts(text, [])
        assert secrets.weak_parts(text, strong) == [p for p in every if not any(s <= p[0] and p[2] <= e for s, _, e in strong)]


@pytest.mark.parametrize("row", [(7, "one row"), (None, None)])
def test_shards_of_one_row_repeated(spark, row):
    """A third of all rows are one row: its copies go to many slots, and shards stay even."""
    docs = frame(spark, [f"text {k}" for k in range(4000)]).unionByName(spark.createDataFrame([row] * 2000, "doc_id long, text string"))
    rows = sharding.shard(docs, 24).collect()
    copies, loads, slots = Counter(), Counter(), {}
    for r in rows:
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        copies[r.vslot] += r.doc_id == row[0]
    assert len(rows) == 6000 and sum(copies.values()) == 2000 + (row[0] == 7) and max(copies.values()) < 10
    assert max(loads.values()) < 1.02 * min(loads.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.edited_shard in (r.shard, 24) for r in rows)


def test_rebalanced():
    m = sharding.SlotMap.balanced([1] * 100, list(range(1, 101)), 4)
    skewed = [500 if s == 0 and k < 20 else b for k, (s, b) in enumerate(zip(m.shard_of, m.n_bytes, strict=True))]
    after = m.rebalanced(skewed)
    gap = lambda x: max(x.loads()) - min(x.loads())
    before = sharding.SlotMap(1, 4, m.shard_of, m.n_rows, tuple(skewed))
    assert after.version == 2 and gap(after) < gap(before) and sum(a != b for a, b in zip(after.shard_of, m.shard_of, strict=True)) < 60


# -- 3 packing


def test_pack(spark, awkward, nothing):
    rng = random.Random(1)
    texts = ["word " * rng.choice([3, 40, 200, 500, 900, 2500]) for _ in range(300)]
    docs = frame(spark, texts).unionByName(awkward.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    cut = packing.pieces(docs, JSON, RANKS, PATTERN)
    rows = packing.pack(cut).collect()
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(spans) <= 1.08 * -(-total // 1024)
    encode = packing.tokenizer(JSON, None, PATTERN)
    for k in (0, 5, 17):
        ids = np.append(encode(texts[k]), 2).astype("<u4")
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == k)
        assert [p for p, *_ in mine] == list(range(len(mine))) and sum(n for _, _, n, _ in mine) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in mine) and all(n == 1024 for _, _, n, _ in mine[1:])
    assert packing.pack(packing.pieces(nothing, JSON, RANKS, PATTERN)).count() == 0


def test_pack_of_one_row_repeated(spark):
    """A third of all pieces are copies of one row: each gets a place of its own, sequences have no gaps."""
    docs = frame(spark, [f"text {k} " * (1 + k % 40) for k in range(800)]).unionByName(spark.createDataFrame([(3, "one row")] * 400, "doc_id long, text string"))
    rows = packing.pack(packing.pieces(docs.repartition(5), JSON, RANKS, PATTERN)).collect()
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    assert len(rows) == 1200 and sum(r.length for r in rows if r.doc_id == 3) >= 400
    for ends in filled.values():
        ends.sort()
        assert [a for a, _ in ends] == [0, *(b for _, b in ends[:-1])] and ends[-1][1] <= 1024


def test_plan_covers_exactly():
    rng = random.Random(7)
    for _ in range(5):
        counts = {rng.randint(1, 64): rng.randint(1, 300) for _ in range(12)}
        used = Counter()
        for pattern, n in packing.plan(counts, 64).items():
            assert sum(x * m for x, m in pattern) <= 64
            for x, m in pattern:
                used[x] += n * m
        assert used == Counter(counts)
    program = packing.plan({400: 1000, 500: 1000, 300: 900, 620: 800, 210: 700}, 1024)
    alone = packing.best_fit({400: 1000, 500: 1000, 300: 900, 620: 800, 210: 700}, 1024)
    assert sum(program.values()) < sum(alone.values())


@pytest.mark.parametrize("seed", range(4))
def test_plan_against_its_bound(seed):
    """On random histograms the fractions come close to the dual bound, and the whole plan to both it and the volume."""
    rng = random.Random(seed)
    counts = {x: rng.randint(200, 3000) for x in rng.sample(range(5, 640), 60)}
    used, bound = packing.fractional(counts, 1024)
    volume = sum(x * n for x, n in counts.items()) / 1024
    covered = Counter()
    for pattern, x in used.items():
        for length, many in pattern:
            covered[length] += many * x
    assert all(covered[x] <= n + 1e-6 for x, n in counts.items())
    rest = sum(x * (n - covered[x]) for x, n in counts.items()) / 1024
    total = sum(packing.plan(counts).values())
    assert volume - 1e-6 <= bound <= total and sum(used.values()) + rest <= 1.02 * bound
    assert total <= 1.01 * bound + 2 and total <= 1.001 * sum(packing.best_fit(counts, 1024).values()) + 1


def test_dual_bound_beats_the_volume():
    """Of three lengths over a third of a sequence two at most fit together: the weights find that."""
    counts = {400: 300, 410: 300, 420: 300}
    used, bound = packing.fractional(counts, 1024)
    assert bound > 445 > 1.2 * sum(x * n for x, n in counts.items()) / 1024 and sum(packing.plan(counts).values()) == 450


def test_tokenizers_agree():
    slow, quick = packing.tokenizer(JSON, None, PATTERN), packing.tokenizer(JSON, RANKS, PATTERN)
    rng = random.Random(3)
    parts = ["the ", "THE", " a", "\n", "\n\n ", "  ", "'s", "'LL", "12", "3456", "é", "ß", "漢字", "😀", "👩\u200d💻", "\u0301", "\u00a0", "\x85", "\t", "<|", "|>", "<|endoftext|>", "_", "-", "...", "ı", "İ", "\u2028", "Ωμ", "र्", "\x00"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0xE000, 0x1F000)])) for _ in range(rng.randrange(1, 30)))
        assert slow(t).tolist() == quick(t).tolist(), t
    for t in ["", "a  b\n\n c", "it's <|endoftext|> 漢字", LONG[:500], " x\x85 y\x1c"]:
        assert slow(t).tolist() == quick(t).tolist()


# -- 4 quality, 6 toxicity


def noisy(rng, good):
    words = [rng.choice(["the", "house", "river", "walks", "green", "under"]) for _ in range(rng.randint(5, 200))]
    return " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)


def test_quality(spark, awkward, nothing):
    rng = random.Random(2)
    y = [rng.random() < 0.7 for _ in range(300)]
    docs, labels = frame(spark, [noisy(rng, g) for g in y]), spark.createDataFrame([(k, int(g)) for k, g in enumerate(y)], "doc_id long, quality int")
    model = quality.fit(docs, labels, "quality", in_fold("doc_id", 3, 1))
    got = {r.doc_id: (r.held, r.score) for r in quality.score(docs, model).select("doc_id", in_fold("doc_id", 3, 1).alias("held"), "score").collect()}
    held = [k for k, (h, _) in got.items() if h]
    assert all(h == (zlib.crc32(str(k).encode()) % 3 == 1) for k, (h, _) in got.items())
    assert np.mean([(got[k][1] >= 0.5) == y[k] for k in held]) > 0.95
    mixed = noisy(rng, True) * 3 + noisy(rng, False) * 3
    x, firsts = quality.encode([mixed, "", "short"])
    a = model.attention(x, firsts)
    assert np.allclose(np.add.reduceat(a, firsts), 1) and len(x) == firsts[-1] + 1
    renamed = awkward.withColumnRenamed("score", "other")
    assert quality.score(renamed, model).where("score between 0 and 1").count() == len(AWKWARD)
    assert quality.score(nothing.drop("score"), model).count() == 0
    assert quality.fit(docs, labels.limit(0), "quality", F.lit(False)) is None
    assert quality.score(renamed, None).where("score = 1").count() == len(AWKWARD)


def test_passages_of_a_fit_are_bounded(spark):
    """Texts of 1, 1, 3 and 100 passages: as many of each as the bound on all of them leaves room for."""
    sample = frame(spark, ["", "short", "x" * 1000, "y" * 40_000])
    assert [quality.passages_each(sample, n) for n in (80_000, 69, 68, 37, 8, 1, 0)] == [64, 64, 32, 32, 2, 1, 1]
    rng = random.Random(3)
    y = [k % 2 for k in range(60)]
    docs = frame(spark, [noisy(rng, g) * 8 for g in y])
    model = quality.fit(docs, spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int"), "quality", F.lit(False), rows=70)
    assert [r.score >= 0.5 for r in quality.score(docs, model).orderBy("doc_id").collect()] == [g == 1 for g in y]


def test_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.random((k, quality.N_FEATURES)).astype(np.float32) for k in (1, 3, 2)]
    m = quality.train(bags, np.array([0, 1, 1], np.float32), np.ones(3, np.float32))
    p = {k: np.asarray(v, np.float64) for k, v in m.p.items()}
    m = quality.Model(m.mean, m.scale, p)
    x, firsts, y, w = np.concatenate(bags).astype(float), np.array([0, 1, 4]), np.array([0.0, 1, 0]), np.array([1.0, 2, 1])

    def loss():
        s = m.forward(x, firsts)[0]
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / w.sum()

    grads = m.gradients(x, firsts, y, w)
    for k in ("v", "u", "a", "c", "b"):
        at = tuple(0 for _ in p[k].shape)
        old, p[k][at] = p[k][at], p[k][at] + 1e-6
        up, p[k][at] = loss(), old - 1e-6
        down, p[k][at] = loss(), old
        assert abs((up - down) / 2e-6 - grads[k][at]) < 1e-6


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_automaton_against_edit_distance():
    rng, terms = random.Random(4), ["abcde", "bcdeab*", "ab", "eeeeeeeeee", "dcba*"]
    lex = toxicity.Lexicon(terms)
    for _ in range(3000):
        w = "".join(rng.choice("abcdex") for _ in range(rng.randint(1, 13)))
        best = []
        for t in terms:
            base, most = t.rstrip("*"), toxicity.allowed(t.rstrip("*"))
            d = min(edits(w[:k], base) for k in range(len(w) + 1)) if t.endswith("*") else edits(w, base)
            best += [d] if d <= most else []
        assert lex.match(w) == (min(best) if best else None), w


def test_toxicity(spark, awkward, nothing):
    rng = random.Random(5)
    words = ["the", "house", "river", "walks", "green", "under", "stone"]
    y = [rng.random() < 0.3 for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) + (f" you {rng.choice(['dreadful', 'rotten', 'blorkish', 'blorkers'])} thing" if t else " you calm thing") for t in y]
    docs, labels = frame(spark, texts), spark.createDataFrame([(k, int(t)) for k, t in enumerate(y)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "toxic", in_fold("doc_id", 4, 2))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k] >= 0.3) == y[k] for k in held]) > 0.95
    extra = toxicity.score(frame(spark, ["a dredful thing", "a calm thing", 'they said "dreadful" of it', None]), model).orderBy("doc_id").collect()
    assert extra[0].score > extra[1].score and extra[2].score < max(got.values()) and extra[3].score == extra[1].score
    assert toxicity.score(awkward.drop("score"), model).count() == len(AWKWARD) and toxicity.score(nothing.drop("score"), model).count() == 0
    silent = toxicity.fit(docs, labels.where("toxic = 0"), "toxic", F.lit(False))
    assert toxicity.score(docs, silent).where("score > 0").count() == 0


def test_lexicon_beyond_its_candidates(spark):
    """Near copies of a long toxic text hold the most frequent candidates; terms of the others are found all the same."""
    rng = random.Random(6)
    family = " ".join(f"rare{k:03d}word" for k in range(60))
    texts = [(1, f"{family} copy{k} of it") for k in range(60)] + [(1, f"number {rng.random()} is {rng.choice(['blorkish', 'dreadful'])}") for _ in range(40)]
    texts += [(0, f"number {rng.random()} is calm") for _ in range(300)]
    sample = spark.createDataFrame(texts, "y int, text string")
    for most in (8000, 50):
        terms = toxicity.lexicon(sample, {0: 300, 1: 100}, most)
        words = toxicity.Words(toxicity.Lexicon(terms))
        assert words["blorkish"] == words["dreadful"] == 0 <= words["rare000word"] and words["number"] < 0 and len(terms) < 20, terms


def test_long_words_by_their_beginnings(spark):
    assert toxicity.entries("a" * 41 + " bcdef 1234567") == {*("a" * k + "*" for k in range(4, 9)), "bcdef", "bcde*"}


def test_sample_is_bounded_and_blind(spark):
    docs = frame(spark, [str(k) for k in range(2000)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(2000)], "doc_id long, y int")
    sample, weight = labelled_sample(docs, labels, "y", in_fold("doc_id", 4, 2), 100)
    ids = [int(r.text) for r in sample.collect()]
    assert 120 < len(ids) < 280 and not [k for k in ids if zlib.crc32(str(k).encode()) % 4 == 2] and weight[1] > 5


# -- 5 top-k


@pytest.mark.parametrize("seed", [0, 1])
def test_top_k(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 70)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(seed)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=6).round(1)]) for k in range(300)]
    rows += [(300, None), (301, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (304, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = {k: np.pad(np.floor(64 * np.array(x, np.float32).astype(float)), (0, 6 - len(x))).astype(int) for k, x in rows if k is not None and (k < 300 or k == 304)}
    want = {q: [(n + 1, k, s) for n, (s, k) in enumerate(sorted(((int(v[q] @ v[k]), k) for k in v if k != q), key=lambda t: (-t[0], t[1]))[:20])] for q in v if q % 20 == 0}
    assert {q: sorted(x) for q, x in got.items()} == want


def lists_of(x):
    order = np.argsort(x, 0, kind="stable")
    return topk.Lists(order, np.take_along_axis(x, order, 0))


def test_top_k_stops_early():
    """A quarter of each list parts the candidates; the scores are resolved by reading on, from nothing but the lists."""
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 3, (4000, 4)).astype(float)
    x[:30] += 100
    query, ids, score, depth = topk.best_of_block(np.arange(4000), lists_of(x), np.array([-1]), np.array([[1.0, 1, 1, 1]]), 20)
    assert set(depth) == {0.25} and score.tolist() == sorted(x.sum(1).astype(int).tolist())[-20:][::-1] and set(ids) <= set(range(30))


@pytest.mark.parametrize("large", [1, 10**3, 10**9, 10**13])
def test_top_k_from_lists_alone(large):
    """All types of sums, against Python's integers."""
    rng = np.random.default_rng(large % 97)
    x, q = ([[int(v) for v in row] for row in rng.integers(-9 * large, 9 * large, (n, 7))] for n in (700, 5))
    most = 7 * 81 * large**2
    exact = next(t[0] for t in topk.TYPES if t[1] is None or most < t[1])
    got = topk.best_of_block(np.arange(700), lists_of(topk.whole(np.array(x, object).astype(float), exact)), np.arange(5) + 700, topk.whole(np.array(q, object).astype(float), exact), 20)
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(u * v for u, v in zip(a, b, strict=True))))
    want = [(700 + n, k, s) for n, row in enumerate(q) for s, k in sorted(((score(row, v), k) for k, v in enumerate(x)), key=lambda t: (-t[0], t[1]))[:20]]
    assert sorted(zip(*(c.tolist() for c in got[:3]), strict=True)) == sorted(want)


def test_top_k_large_and_long(spark):
    """Components of any finite size, vectors of any length, and one id and vector in very many rows."""
    rows = [(0, [1e20, 0.0]), (1, [1.0] * 3000), (2, [4e7, 1.0]), (3, [-1e9]), (4, []), (5, [1.7e308]), (6, [0.5, 2.0])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 4, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    most = 2**63 - 1
    assert sorted(got[0]) == [(1, 1, most), (2, 2, most), (3, 5, most)]
    assert sorted(got[1]) == [(1, 0, most), (2, 5, most), (3, 2, 64 * (64 * 4 * 10**7 + 64))]
    assert sorted(got[2])[:2] == [(1, 0, most), (2, 5, most)] and sorted(got[3])[:1] == [(1, 4, 0)]
    same = spark.range(40000).select(F.lit(7).alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")).unionByName(spark.createDataFrame([(0, [1.0, 1.0])], "vec_id long, embedding array<double>"))
    assert [(r.vec_id, r.score) for r in topk.top_k(same, F.col("vec_id") == 0, 3).collect()] == [(7, 3 * 64 * 64)] * 3


def test_top_k_small(spark):
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.lit(True)).count() == 0 and topk.top_k(one.limit(0), F.lit(True)).count() == 0
    none = spark.createDataFrame([(0, []), (1, [])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in topk.top_k(none, F.lit(True)).collect()) == [(0, 1, 0), (1, 0, 0)]


# -- 7 fingerprints


def test_fingerprints(spark, awkward, nothing):
    texts = [r.text or "" for r in awkward.where("doc_id is not null").orderBy("doc_id", "text").collect()]
    ids = [r.doc_id for r in awkward.where("doc_id is not null").orderBy("doc_id", "text").collect()]
    rows = fingerprint.with_edits(awkward.where("doc_id is not null")).collect()
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows)
    want = Counter()
    for k, t in enumerate(texts):
        h = len(t) // 2
        want[ids[k], len(t), hashlib.sha256((t[: len(t) - h] + texts[(k + 1) % len(texts)][:h]).encode()).hexdigest()] += 1
    assert got == want
    assert len({r.fingerprint for r in rows if r.doc_id in (0, 5)}) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprint.with_edits(awkward).count() == len(AWKWARD) and fingerprint.with_edits(nothing).count() == 0
    assert fingerprint.with_edits(awkward.limit(1)).first().near_next == 1.0


def test_homomorphism(spark):
    a, b = "one line.\ntwo line\nthree\n", "four\nfive line\n"
    rows = frame(spark, [a, b, a + b, "three\n" + "two line\n" + "one line."])
    f = fingerprint.fingerprints(rows, ["doc_id"], "text").cache()
    x = {r.doc_id: r.lanes for r in f.collect()}
    assert x[0] == x[3] and x[0] != x[1]  # order doesn't matter
    both = f.where("doc_id = 0").select(F.col("lanes").alias("p")).crossJoin(f.where("doc_id = 1").select(F.col("lanes").alias("q")))
    r = both.select(fingerprint.combined(F.col("p"), F.col("q")).alias("s"), fingerprint.combined(fingerprint.combined(F.col("p"), F.col("q")), F.col("q"), -1).alias("d")).first()
    assert r.s == x[2] and r.d == x[0]


def test_likeness_orders(spark):
    lines = [f"line number {k}" for k in range(200)]
    texts = ["\n".join(lines[: 200 - d] + [f"other {k}" for k in range(d)]) for d in (0, 10, 60, 200)]
    f = fingerprint.fingerprints(frame(spark, texts), ["doc_id"], "text")
    first = f.where("doc_id = 0").select(F.col("lanes").alias("base"))
    near = [r.n for r in f.crossJoin(first).select("doc_id", fingerprint.likeness(F.col("base"), F.col("lanes")).alias("n")).orderBy("doc_id").collect()]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] and abs(near[1] - 0.95) < 0.05 and abs(near[2] - 0.7) < 0.2


# -- 8 near duplicates


def brute(texts, size, percent):
    sets = {}
    for k, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = set(zip(*[w[i:] for i in range(size)], strict=False)) if len(w) >= size else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def variants(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(1, 150))]
        for _ in range(rng.choice([1, 1, 1, 3, 9])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy) if rng.random() < 0.8 else "  ".join(copy).upper())
    return [*enumerate(out)]


@pytest.mark.parametrize(("seed", "size", "percent", "small"), [(1, 3, 85, False), (2, 5, 80, False), (3, 3, 85, True)])
def test_near_duplicates(spark, seed, size, percent, small, monkeypatch):
    if small:  # large regions, large clusters and distributed rounds, on few rows
        for name, value in (("WINDOW", 1), ("CLUSTER", 3), ("ROOM", 400), ("GROUP", 4), ("BROADCAST_IDS", 0)):
            monkeypatch.setattr(neardup, name, value)
        monkeypatch.setattr(neardup.components, "__defaults__", (0,))
    texts = variants(seed, 25 if small else 120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), size, percent).collect()}
    assert got == brute(texts, size, percent)


def test_near_duplicates_in_crowded_regions(spark, monkeypatch):
    """Planted near copies among texts of the same few words: the first region holds all, and nearly nothing else is left to the forest."""
    for name, value in (("TREES", 2), ("SHORTEST", 0), ("WINDOW", 3), ("PARTS", 2), ("ORDER_CLASSES", 300), ("SEARCHED", (0,))):
        monkeypatch.setattr(neardup, name, value, raising=False)
    rng = np.random.default_rng(21)
    picks = (rng.random((1500, 200)) < 0.2).astype(int)
    copies = picks[:200].copy()
    copies[:, :8] ^= 1  # 192 of 208 words alike
    picks = np.concatenate([picks, copies])
    shared = np.where(picks, 1, -1) @ np.where(picks, 1, -1).T // 2 + 100
    i, j = np.nonzero(np.triu(100 * shared >= 90 * (400 - shared), 1))
    root = list(range(len(picks)))
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    docs = frame(spark, [" ".join(f"s{k}o{v}" for k, v in enumerate(row)) for row in picks])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 1, 90).collect()}
    assert len(i) >= 200 and got == dict(enumerate(root))


def test_neighbours_across_ranges(spark):
    """However the sorted orders are dealt into ranges, the same regions are seen whole: 40 rows alike, then single ones."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**16, neardup.N_HASHES)
    rows = []
    for k in range(400):
        own = rng.integers(0, 2**16, neardup.N_HASHES)
        values = np.where(rng.random(neardup.N_HASHES) < 0.95, base, own) if k < 40 else own
        rows.append((k, bytearray(values.astype(np.uint8).tobytes()), bytearray(values.astype("<u2").tobytes())))
    classes = spark.createDataFrame(rows, "node long, sig binary, orders binary")
    seen = set()
    for parts in (1, 3, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        try:
            links, crowded = neardup.forest_links(classes, 0.85)
            root = {r.node: r.component for r in neardup.components(links).collect()}
            seen.add((frozenset(root.items()), frozenset(r.node for r in crowded.collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (root, crowded), *others = seen
    assert not others and dict(root) == {k: 0 for k in range(40)} and crowded <= set(range(40))


def test_near_copies_in_a_dense_table(spark):
    """Pairs of likeness 0.86 among 3000 texts that share 60 % of their shingles with all others: none is lost."""
    rng = random.Random(5)
    shared, texts = [f"s{k}" for k in range(150)], []
    for k in range(1500):
        own = [f"w{rng.randrange(10**9)}" for _ in range(50)]
        other = own[:35] + [f"w{rng.randrange(10**9)}" for _ in range(15)]
        texts += [(2 * k, " ".join(shared + own)), (2 * k + 1, " ".join(shared + other))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85).collect()}
    assert got == {k: k // 2 * 2 for k in range(3000)}


def test_recall_of_the_forest(spark):
    """At the real constants: 2000 pairs just over the threshold, of sets of 40 to 400 shingles, in a sparse table."""
    rng, texts = random.Random(6), []
    for k in range(2000):
        n = rng.randrange(40, 400)
        words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        cut = n - n * 15 // 215 - 1
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:cut] + [f"v{rng.randrange(10**9)}" for _ in range(n - cut)]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 1, 85).collect()}
    linked = [k for k in range(0, 4000, 2) if 100 * len(set(texts[k][1].split()) & set(texts[k + 1][1].split())) >= 85 * len(set(texts[k][1].split()) | set(texts[k + 1][1].split()))]
    assert len(linked) > 1000 and all(got[k + 1] == k for k in linked)


def test_prefixes_of_linked_sets_meet():
    rng = random.Random(4)
    for _ in range(3000):
        percent, pool = rng.choice([50, 80, 85]), list(range(60))
        a = set(rng.sample(pool, rng.randint(1, 50)))
        b = set(rng.sample(sorted(a), rng.randint(max(1, len(a) * 3 // 4), len(a)))) | set(rng.sample(pool, rng.randint(0, 5)))
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((a, b), key=len)
            assert set(sorted(x)[: neardup.prefixes(len(x), percent)[0]]) & set(sorted(y)[: neardup.prefixes(len(y), percent)[1]])


def test_one_large_group(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = [(k, " ".join(base[:j] + [f"x{k}"] + base[j:])) for k in range(900) for j in [rng.randrange(120)]]
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85)
    assert {r.component_id for r in got.collect()} == {0} and got.where("kept").count() == 1


def test_near_duplicates_awkward(spark, awkward, nothing):
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(awkward, 3, 85).collect()]
    assert len(rows) == len(AWKWARD) and (5, 3, 0, False) in rows and (1, 0, 1, True) in rows and (8, 1, 8, True) in rows and (None, 1, None, True) in rows
    assert neardup.near_duplicates(nothing).count() == 0
    left = neardup.without_copies(awkward, 3, 85)
    assert left.columns == awkward.columns and sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 7, 8]
    again = spark.createDataFrame([(1, "same words here now"), (1, "same words here now"), (None, "same words here now")], "doc_id long, text string")
    assert neardup.without_copies(again, 3, 85).count() == 2


def test_without_copies_of_repeated_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(3, a), (5, a), (5, b), (5, b), (7, "c d e"), (7, "f g h"), (8, b + " x"), (9, "i j k"), (9, "I J K"), (6, None), (6, ""), (6, "l m n")]
    left = sorted((r.doc_id, (r.text or "").lower()) for r in neardup.without_copies(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert left == [(3, a), (5, b), (6, ""), (6, "l m n"), (7, "c d e"), (7, "f g h"), (9, "i j k")]


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    links = [(k, k + 1) for k in range(0, 60)] + [(100 + k, 100) for k in range(1, 40)] + [(5, 5), (300, 200)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(links, "a long, b long"), one_task).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{100 + k: 100 for k in range(40)}, 200: 200, 300: 200}


# -- 9 chat


def test_reply_trees(spark):
    rows = [(1, 0, None, 1.0), (1, 1, 0, 0.1), (1, 2, 0, 0.9), (1, 3, 2, 0.2), (1, 4, 2, 0.8), (2, 7, None, 0.0), (2, 8, 99, 5.0), (3, 1, 2, 1.0), (3, 2, 1, 1.0), (None, 1, None, 1.0)]
    m = spark.createDataFrame([(t, n, p, s, "user" if n % 2 else "assistant", f"m{n}") for t, n, p, s in rows], "tree long, node long, parent long, score double, role string, text string")
    paths = {}
    for r in chat.best_paths(m, 2).orderBy("tree", "rank", "place").collect():
        paths.setdefault((r.tree, r["rank"]), []).append(r.node)
    assert paths == {(1, 1): [0, 2, 4], (1, 2): [0, 2, 3], (2, 1): [8], (2, 2): [7], (None, 1): [1]}
    text = {(r.tree, r.path): r.text for r in chat.conversations(chat.formatted(m, chat.best_paths(m))).collect()}
    assert text[1, 4] == "<|im_start|>assistant\nm0<|im_end|>\n<|im_start|>assistant\nm2<|im_end|>\n<|im_start|>assistant\nm4<|im_end|>\n"


def test_long_thread_and_round_trip(spark):
    hard = ["<|im_end|>", "\\<|", "<", "|>", "\\", "a\nb", "", None, "<|im_start|>assistant\nx<|im_end|>\n", "<\\|>", "é😀"]
    rows = [(1, k, "assistant" if k % 2 else "user", hard[k % len(hard)]) for k in range(600)] + [(2, 0, "odd\n\\role", "t"), (2, 0, "odd\n\\role", "t"), (2, None, None, "first"), (None, 1, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    m = chat.threads(turns).cache()
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(m, chat.best_paths(m))).collect()}
    assert set(got) == {1, 2, None}
    want, loss = hashlib.sha256(), "".join(t or "" for _, k, r, t in rows if _ == 1 and r == "assistant")
    for c, k, role, text in rows:
        if c == 1:
            want.update(f"{role}\n{text or ''}\n".encode())
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (600, want.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].n_turns == 3 and got[2].turns_sha256 == hashlib.sha256(b"\nfirst\n" + b"odd\n\\role\nt\n" * 2).hexdigest()
    assert chat.read_back(chat.formatted(m.limit(0), chat.best_paths(m.limit(0)))).count() == 0


# -- 10 byte-level BPE


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_exact(reference_encoding):
    v, encoder = bpe.vocabulary(RANKS, PATTERN)
    rng = random.Random(6)
    odd = ["", " ", "  a  b \n c\t", "a's  don't", "\x1c a \x1c", "aaaa" * 3000, " " * 900 + "x", "1234567 8 "]
    odd += ["".join(rng.choice(["a", "b", " ", "'s", "\n", "\t", "é", "漢", "😀", "1", "  ", "\xa0", " ", "　", "\x85", "!", ",", "-", "the", "ing"]) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    for t in odd:
        ids = memoryview(encoder([t])[0]).cast("I").tolist()
        assert ids == reference_encoding.encode_ordinary(t) and v.decode(ids) == t.encode(), repr(t)
    assert [*bpe.Vocabulary(bpe.read_ranks(RANKS), PATTERN).merged(b" hello")] == [b" hello"]


def test_bpe_query(spark, awkward, nothing, reference_encoding):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(awkward, RANKS, PATTERN).collect())
    want = Counter()
    for k, t in AWKWARD:
        ids = np.array(reference_encoding.encode_ordinary(t or ""), "<u4")
        want[k, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want and bpe.round_trip(nothing, RANKS, PATTERN).count() == 0


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    v = bpe.Vocabulary(bpe.read_ranks(RANKS), PATTERN)
    e = bpe.ChunkEncoder(lambda ts: [*map(v.encode, ts)])
    for k in range(50):
        e([f"w{k} x{k} y{k}"])
    assert len(v.pieces) <= 5 and len(e.known) <= 5 + 3 and len(v.pairs) <= 20
