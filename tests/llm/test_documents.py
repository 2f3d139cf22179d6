"""Operators on documents against brute force, on the small tables and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from edgewise.llm import bpe, chunks, neardup, packing, quality, queries, tokenfiles, toxicity

BYTES, WORDS = queries.BYTE_LEVEL, queries.WORD_LEVEL
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "no id"), (7, LONG), (8, LONG + " end"),
    (9, "x <|endoftext|>y  <|endoftext|>  z <|startoftext|>"), (10, "a\x1cb \x1c c  d"), (11, "\n\n\na  \t b\r\n"), (12, "don't 'S 123a ４５ é é ΑΣ İI 😀"),
    (13, "! ! !"), (14, "A\x00b \x00c"), (15, "Ends, here. And.. there,."), (16, "\nlead"), (17, "trail "),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, sig string, rep string, key int, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", None, None, 1, "s", "r", 2, None) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def library_ids(path, text):
    return chunks.library(path).encode(text, add_special_tokens=False).ids


def as_bytes(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def check_bpe(got, rows):
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(
        (i or 0, len(ids), hashlib.sha256(as_bytes(ids)).hexdigest(), hashlib.sha256(chunks.library(BYTES).decode(ids, skip_special_tokens=False).encode()).hexdigest())
        for i, t in rows
        for ids in [library_ids(BYTES, t or "")]
    )


def test_bpe_matches_the_library(spark, sf_dir, rows, odd, empty):
    check_bpe(queries.op3_bpe(spark, sf_dir).collect(), rows)
    check_bpe(bpe.bpe_round_trip(odd, BYTES).collect(), ODD)
    assert bpe.bpe_round_trip(empty, BYTES).count() == 0


def test_bpe_of_long_pieces():
    draw = random.Random(3)
    texts = ["a" * 5000, "ab" * 4000, "".join(draw.choice("etaoinß") for _ in range(8000)), *("".join(draw.choice("theinr") for _ in range(700 + k)) for k in range(70))]
    for text, ids in zip(texts, bpe.byte_bpe(BYTES).encode(texts), strict=True):
        assert ids == as_bytes(library_ids(BYTES, text))


def check_files(got, rows):
    before, want = 0, []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0], x[1] or "")):
        ids = [*library_ids(BYTES, t or ""), 0]
        want.append((i or 0, before, len(ids), zlib.crc32(as_bytes(ids))))
        before += len(ids)
    assert sorted((r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)


def test_token_files(spark, sf_dir, rows, odd, empty):
    check_files(queries.op6_token_files(spark, sf_dir).collect(), rows)
    check_files(tokenfiles.token_files(odd, BYTES).collect(), ODD)
    assert tokenfiles.token_files(empty, BYTES).count() == 0


def test_shard_random_access(rows):
    encoded = [as_bytes([*library_ids(BYTES, t), 0]) for _, t in rows[:80]] + [b""]
    blob = tokenfiles.compress(encoded, 50257)
    shard = tokenfiles.Shard(blob)
    assert [shard.document(k).astype("<u4").tobytes() for k in range(81)] == encoded
    assert len(shard.rules) > 10 and len(shard.seq) < shard.tokens.sum()
    for k in (0, 40, 79):
        ids = shard.document(k)
        assert [shard.id_at(k, p) for p in range(0, len(ids), 37)] == ids[::37].tolist()


def test_shards_of_copies_shrink_until_it_does_not_pay():
    draw = random.Random(4)
    text = as_bytes([draw.randrange(60_000) for _ in range(500)])
    parts = [text + as_bytes([k]) for k in range(300)]
    shard = tokenfiles.Shard(tokenfiles.compress(parts, 65_500))
    assert [shard.document(k).astype("<u4").tobytes() for k in range(300)] == parts
    assert len(shard.seq) < 300 * 4 and shard.seq.max() > 65_535
    assert [shard.id_at(299, p) for p in range(501)] == shard.document(299).tolist()


@pytest.mark.parametrize("ids", [[7] * 101, [1, 2] * 50, [5], [0, 0, 0], list(range(300)) * 3])
def test_shard_repetition(ids):
    parts = [as_bytes(ids), as_bytes(ids[::-1]), b"", as_bytes([9])]
    shard = tokenfiles.Shard(tokenfiles.compress(parts, 400))
    assert [shard.document(k).astype("<u4").tobytes() for k in range(4)] == parts


def check_pieces(got, rows):
    documents = Counter()
    for i, t in rows:
        documents[i, as_bytes([*library_ids(WORDS, t or ""), 1])] += 1
    at, sequences = {}, {}
    for r in got:
        at.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = Counter()
    for (i, ids), times in documents.items():
        want[i] += times * len(ids) // 4
    assert {i: sum(r["length"] for r in rs) for i, rs in at.items()} == dict(want)
    single = {i: ids for (i, ids), times in documents.items() if times == 1 and sum(1 for x in documents if x[0] == i) == 1}
    for i, ids in single.items():
        pieces, end = sorted(at[i], key=lambda r: r["start"]), 0
        for r in pieces:
            assert (r["start"], r["doc_tokens"]) == (end, len(ids) // 4)
            end += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * end])
        assert end == len(ids) // 4
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding == 0


def test_packing(spark, sf_dir, rows, odd, empty):
    check_pieces(queries.op9_packing(spark, sf_dir).collect(), rows)
    check_pieces(packing.pack(odd, WORDS).collect(), ODD)
    assert packing.pack(empty, WORDS).count() == 0


def test_packing_balances_cost():
    lengths = [700, 300, 900, 20, 60, 1500, 44, 2048, 3000, 1, 700, 700]
    pieces = packing.assign(lengths)
    totals, costs = Counter(), Counter()
    for _, _, length, k, _ in pieces:
        totals[k] += length
        costs[k] += packing.cost(length)
    assert sum(totals.values()) == sum(lengths) and max(totals.values()) == 2048
    assert all(n == 2048 or n & (n - 1) == 0 for n in totals.values())


def base_of(text):
    words = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    shares = {}
    for n in quality.MAX_NGRAM_SHARE:
        grams = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        chars = {k + d for k in range(len(words) - n + 1) if grams[tuple(words[k : k + n])] > 1 for d in range(n)}
        shares[n] = sum(len(words[k]) for k in chars) / max(1, sum(map(len, words)))
    seen, lines = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            lines += len(line) if line in seen else 0
            seen.add(line)
    kept = not failed and all(shares[n] <= most for n, most in quality.MAX_NGRAM_SHARE.items()) and lines <= quality.MAX_LINE_SHARE * len(text)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed, kept


def test_quality(spark, sf_dir, rows, odd, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for frame, texts in ((queries.op10_quality(spark, sf_dir), rows), (quality.quality_report(odd), ODD)):
        got = sorted(((r["doc_id"] or 0), *(r[n] for n in names)) for r in frame.collect())
        assert got == sorted(((i or 0), *base_of(t or "")) for i, t in texts)
    assert quality.quality_report(empty).count() == 0
    kept = quality.quality_filter(odd)
    assert kept.columns == odd.columns and kept.count() == sum(base_of(t or "")[6] for _, t in ODD)


def sets_of(rows):
    """The set of each row with a doc_id, by the row's number; rows of equal doc_id are documents of their own."""
    out = {}
    for at, (i, t) in enumerate(rows):
        w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[at] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(rows):
    sets = {at: s for at, s in sets_of(rows).items() if rows[at][0] is not None}
    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    shared = Counter()
    for ids in by_shingle.values():
        ids = sorted(ids)
        for a in range(len(ids)):
            for b in ids[a + 1 :]:
                shared[ids[a], b] += 1
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), both in shared.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    least = {}
    for at in sets:
        least[root(at)] = min(least.get(root(at), rows[at][0]), rows[at][0])
    return {at: (root(at), len(sets[at]), least[root(at)]) for at in sets}


def check_near(got, rows):
    want = Counter((i, found[at][1], found[at][2], found[at][2] == i) if at in found else (i, len(sets[at]), None, True) for found, sets in [(brute_components(rows), sets_of(rows))] for at, (i, t) in enumerate(rows))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want


def check_dropped(got, rows):
    """Exactly one row of each component, of its least doc_id; all rows without words or doc_id."""
    found, left = brute_components(rows), Counter((r["doc_id"], r["text"]) for r in got)
    groups = {}
    for at, (i, t) in enumerate(rows):
        if at not in found or not found[at][1]:
            left[i, t] -= 1
        else:
            groups.setdefault(found[at][0], []).append((i, t))
    for members in groups.values():
        least = min(i for i, _ in members)
        kept = [m for m in {m for m in members if m[0] == least} if left[m] > 0]
        assert kept, members[:3]
        left[kept[0]] -= 1
    assert not any(left.values()), {k: n for k, n in left.items() if n}


def test_near_duplicates(spark, sf_dir, rows, odd, empty):
    check_near(queries.op7_near_duplicates(spark, sf_dir).collect(), rows)
    check_near(neardup.near_duplicates(odd).collect(), ODD)
    assert neardup.near_duplicates(empty).count() == 0
    once = neardup.drop_near_duplicates(odd)
    assert once.columns == odd.columns
    check_dropped(once.collect(), ODD)
    assert neardup.drop_near_duplicates(empty).count() == 0


def test_near_duplicates_of_shared_ids(spark):
    """Rows that share a doc_id and differ in text are documents of their own; none is lost."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (4, b + " more"), (5, a + " end"), (5, a + " end"), (5, a + " fin"), (6, ""), (6, None), (6, c), (None, a), (7, "x y"), (7, "x z"), (8, "X Y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'h' AS text_hash", "1 AS kept", "2 AS component", "3 AS place", "map(1, 2) AS m")
    check_near(neardup.near_duplicates(frame).collect(), rows)
    check_dropped(neardup.drop_near_duplicates(frame).collect(), rows)


def test_near_duplicate_chains(spark):
    """Links that only neighbours of a chain have, and a group whose hub is unlike some members."""
    base = [f"w{k}" for k in range(120)]
    rows = [(100 - d, " ".join(base[4 * d : 4 * d + 60])) for d in range(12)]
    rows += [(200 + d, " ".join([*base[:40], *(f"x{d}{k}" for k in range(8))])) for d in range(30)]
    check_near(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Large buckets in several blocks: near copies of one text that are unlike the bucket's smallest member."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    draw = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for d in range(90):
        words = list(base)
        for _ in range(draw.choice([2, 4, 6, 8])):
            words[draw.randrange(150)] = f"x{d}{draw.random()}"
        rows.append((d, " ".join(words)))
    check_near(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_common_counts():
    draw = random.Random(6)
    sets = [np.unique([draw.randrange(60) for _ in range(n)]) for n in (0, 1, 20, 40, 50, 50)]
    got = neardup.common_counts(sets, columns=7)
    assert all(got[a, b] == len(set(sets[a].tolist()) & set(sets[b].tolist())) for a in range(6) for b in range(6) if a != b)


def test_components_by_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (200, 201)]
    found = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 160)} | {k: 200 for k in (200, 201, 202)}


def test_toxicity_on_held_out_rows(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, sf_dir).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    right = [got[i]["predicted"] == t for i, t in labels.items() if got[i]["held_out"]]
    assert sum(right) >= 0.93 * len(right)


def test_toxicity_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(odd, none)
    got = toxicity.score_documents(odd, model).collect()
    assert len(got) == len(ODD) and all(not r["predicted"] for r in got)
    assert toxicity.score_documents(empty, model).count() == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.learn(empty, none).stems == {}


def test_toxicity_grammar():
    model = toxicity.ToxicityModel({"idiot": 4.0, "kill": 0.0}, {"moro": 4.0}, 1.0, -2.0)
    plain, aimed = model.total("The idiot left."), model.total("You are an idiot.")
    assert 0 < plain < aimed
    assert model.total("You are not an idiot.") < aimed
    assert model.total("He said that the idiot left.") < aimed
    assert model.total("Killing time. We kill bugs") == 0 < model.total("I will kill you. You I kill")
    assert model.total("morons") == 4.0 and model.total("oxymorons") == 0
    assert model.score("You idiot, you moron.") > 0.5 > model.score("")


def test_toxicity_clauses():
    model = toxicity.ToxicityModel({"idiot": 4.0, "scum": 6.0}, {}, 1.0, -2.0)
    wanted = {
        "I will kill you": 2.0, "kill you": 2.0, "you kill": 2.0, "kill and hurt you": 4.0, "do not kill": 0.0, "do not kill you": 1.0, "he said kill": 1.5, "she said to kill you": 1.5,
        "we kill time": 0.0, "idiot, you": 5.0, "you idiot": 5.0, "scum, all of you": 7.5, "an idiot": 4.0, "you are not an idiot": 2.0, "no idiot": 2.0, "kill. You": 0.0,
    }
    assert {text: model.total(text) for text in wanted} == wanted


def plain_total(model, text):
    """The grammar's rules, clause by clause, without transducers."""
    listed = {k: set(w.split()) for k, w in (("threat", toxicity.THREATS), ("target", toxicity.TARGETS), ("not", toxicity.NEGATIONS), ("told", toxicity.REPORTS))}
    total = 0.0
    for clause in re.split(r"[.!?;:\n]+", text.lower()):
        words = re.findall(r"\w+", clause)
        weights = [max([model.words.get(w, 0.0), *(x for s, x in model.stems.items() if w.startswith(s))]) for w in words]
        kinds = ["insult" if x > 0 else next((k for k, ws in listed.items() if w in ws), "") for w, x in zip(words, weights, strict=True)]
        aimed, denied, told = "target" in kinds, 0, False
        for kind, weight in zip(kinds, weights, strict=True):
            if kind == "not":
                denied = 4
            told = told or kind == "told"
            if kind == "insult":
                total += weight * (0.5 if denied > 0 else 0.75 if told else 1.25 if aimed else 1.0)
            if kind == "threat" and aimed:
                total += toxicity.DEFAULT_WEIGHT * 0.5 * (0.5 if denied > 0 else 0.75 if told else 1.0)
            denied -= 1
    return total


def test_toxicity_scores_by_plain_rules(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels)
    again = toxicity.learn(docs.repartition(3).union(docs.limit(20)), labels.orderBy("doc_id"))
    assert (model.words, model.stems) == (again.words, again.stems)
    draw = random.Random(8)
    lists = [toxicity.INSULTS, toxicity.THREATS, toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS]
    made = [" ".join(draw.choice([draw.choice(draw.choice(lists).split()), "word", "and.", "so;"]) for _ in range(12)) for _ in range(300)]
    for text in [t for _, t in rows[:120]] + made + [" ".join(made) * 20]:
        assert abs(model.total(text) - plain_total(model, text)) < 1e-6, text[:200]
