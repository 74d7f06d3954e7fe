"""Operators over documents, each against a plain restatement, with awkward rows among ordinary ones."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, language_id, license_scan, mixing, quality_model, quality_rules, simhash, tokens, toxicity
from tidelog.llm.graph import components
from tidelog.llm.learning import chosen, hash_sample

WORD = re.compile("[^\x20\x09-\x0d]+")
DOC = "doc_id long, text string, lang string, source string, score string, kept string, row string, words string"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, "s", "k", "r", "w") for i, t, lang, source in rows], DOC)


def prose(rng, n, words="the of and to a in that is was it stone river light winter paper house morning garden letter window".split()):
    return " ".join(rng.choice(words) if rng.random() < 0.7 else "".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    long = prose(rng, 30_000)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "en", "a"), (5, "one two", "en", None), (None, prose(rng, 80), "en", "b"), (6, long, "en", "a"), (7, "x " * 200, "en", "a")]
    rows += [(8, "Zwölf Boxkämpfer jagen\nZwölf Boxkämpfer jagen\n\n###", "de", "b"), (9, "ab\x1ccd\x0bef é́ 日本語 🙂", "xx", "b")]
    rows += [(10 + k, prose(rng, 60 + k), "en", f"s{k % 3}") for k in range(20)]
    rows += [rows[12], rows[12], (10, "another text with an id that is taken " * 9, "en", "a")]
    return frame(spark, rows)


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    again = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(words) < 2000 else None
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat = None if again is None else len(again)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat


def test_quality_rules(odd):
    got = quality_rules.score_rules(odd).select("row.doc_id", "row.text", "measures.*", "base_failed", "kept").collect()
    assert len(got) == odd.count()
    for r in got:
        want = measured(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == want[:4]
        if want[4] is not None:
            assert r["n_repeat_words"] == want[4]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert {r["doc_id"] for r in got if r["kept"]} >= {6, 12, 13}
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality_rules.keep_good(odd.limit(0)).count() == 0


@pytest.mark.parametrize("junk", ["WORD!! " * 60, "word*** other### " * 40, "a | b | c | d " * 30, "Same " * 80])
def test_quality_rules_reject(spark, junk):
    assert quality_rules.keep_good(frame(spark, [(1, junk, "en", "a")])).count() == 0


def fingerprint(text, k=3):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = WORD.findall(lower)
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, bits):
    """Value to least value reachable, comparing all pairs."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprints(odd):
    got = simhash.fingerprints(odd.where("doc_id <> 6")).join(odd.select("doc_id", "text"), "doc_id").collect()
    texts = {(r["doc_id"], r["text"]): r["fp"] for r in got if r["doc_id"] != 10}
    assert texts and all(fp & (2**64 - 1) == fingerprint(t) for (_, t), fp in texts.items())
    assert texts[1, None] == texts[2, ""] == 0


def test_majority_of_long_runs(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 5)
    rng = np.random.default_rng(0)
    sizes = [0, 3, 17, 1, 0, 5, 2, 0]
    hashes, offsets = rng.integers(0, 2**64, sum(sizes), dtype=np.uint64), np.concatenate(([0], np.cumsum(sizes)))
    got = simhash.majority_bits(hashes, offsets)
    for k, n in enumerate(sizes):
        run = [int(h) for h in hashes[offsets[k] : offsets[k + 1]]]
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in run) > n)


@pytest.mark.parametrize("bits, segments", [(2, 2), (3, 2), (1, 2), (4, 3)])
@pytest.mark.parametrize("bucket", [64, 1])
def test_links_reach_what_brute_force_reaches(spark, bits, segments, bucket):
    """Also with every shared segment value treated as hot, and with a crowd around one value."""
    rng = random.Random(bits)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    values = {0, 2**64 - 1, *seeds}
    for s in seeds:
        for _ in range(6):
            values.add(s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    values |= {seeds[0] ^ (1 << b) for b in range(40)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = simhash.links(fps, bits, segments, bucket)
    pairs = [(r["src"] & (2**64 - 1), r["dst"] & (2**64 - 1)) for r in found.collect()]
    assert all((a ^ b).bit_count() <= bits for a, b in pairs)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {v: find(v) for v in values} == linked(values, bits)


def broadcast_unseen(df):
    """What ``df``'s plan would broadcast although it is made by ``explode``, whose rows Spark does not count before it has run."""
    found, inside = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth <= inside:
            inside = None
        if inside is None and "BroadcastExchange" in line:
            inside = depth
        elif inside is not None and "Generate" in line:
            found.append(line)
    return found


@pytest.fixture
def plans(spark, monkeypatch):
    """Labels and exploded broadcasts of the tables that ``simhash`` writes, where Spark may broadcast 10 MB."""
    seen, write = [], simhash.durable

    def watched(df, label, *a):
        seen.append((label, broadcast_unseen(df)))
        return write(df, label, *a)

    monkeypatch.setattr(simhash, "durable", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield seen
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("bucket", [64, 1])
def test_probes_are_never_broadcast(spark, tmp_path, plans, bucket):
    """A table of fingerprints is small beside its probes, 34 each, or the 2 081 points of a ball."""
    rng = random.Random(6)
    base = [rng.getrandbits(62) for _ in range(40)]
    values = sorted({x ^ (1 << rng.randrange(32)) for x in base for _ in range(4)} | set(base))
    spark.createDataFrame([(v,) for v in values], "fp long").write.parquet(f"{tmp_path}/fps")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/fps"), 2, 2, bucket)
    assert [x for x, _ in plans] == ["hits"] and not plans[0][1] and not broadcast_unseen(found)
    want, at = linked(values, 2), {v: k for k, v in enumerate(values)}
    assert unite(len(values), [(at[r["src"]], at[r["dst"]]) for r in found.collect()]) == [at[want[v]] for v in values]


def test_bands_are_never_broadcast(spark, tmp_path, plans):
    """A node has 26 bands, which Spark takes for one."""
    rng = random.Random(7)
    texts = [prose(rng, 80) for _ in range(30)]
    texts += [x + " again" for x in texts[:10]]
    frame(spark, [(k, x, "en", "a") for k, x in enumerate(texts)]).write.parquet(f"{tmp_path}/docs")
    got = simhash.near_duplicates(spark.read.parquet(f"{tmp_path}/docs"))
    assert {"hits", "held", "edges"} <= {x for x, _ in plans}
    assert not [x for x in plans if x[0] in ("hits", "held", "edges") and x[1]]
    assert all(r["component_id"] == r["doc_id"] % 30 for r in got.collect())


def test_many_hashes_are_dealt(spark, tmp_path, monkeypatch):
    """Lists that are all alike take hardly any file, and yet their memory."""
    monkeypatch.setattr(simhash, "BROADCAST_HASHES", 1000)
    spark.range(40).select(F.col("id").alias("node"), F.sequence(F.lit(1), F.lit(50)).alias("shingles")).write.parquet(f"{tmp_path}/sets")
    sets, plan = spark.read.parquet(f"{tmp_path}/sets"), lambda df: df._jdf.queryExecution().executedPlan().toString()
    other = spark.range(40).withColumnRenamed("id", "node")
    assert "BroadcastExchange" in plan(other.join(sets, "node"))
    assert "BroadcastExchange" in plan(other.join(simhash._weighed(sets), "node"))
    assert "BroadcastExchange" not in plan(other.join(simhash._weighed(sets, "shingles"), "node"))
    assert simhash._weighed(sets.limit(0), "shingles").count() == 0


def test_components(spark):
    """A long chain, a star, a loop, a repeated and reversed edge."""
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 200), (301, 300), (300, 301), (None, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100 + k: 100 for k in range(50)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def unite(n, pairs):
    """The least index that each of ``n`` indices reaches over ``pairs``."""
    root = list(range(n))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def shingles_of(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < k else [tuple(words[i : i + k]) for i in range(len(words) - k + 1)])


def similar(a, b, least=0.8):
    return a == b or len(a & b) >= least * len(a | b) - 1e-9


def test_near_duplicates(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    sets = [shingles_of(t) for _, t in rows]
    root = unite(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if similar(sets[a], sets[b])])
    least = {}
    for r, (i, _) in zip(root, rows, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(((i, least[r]) for r, (i, _) in zip(root, rows, strict=True)), key=str)


def test_fingerprint_components(odd):
    got = simhash.near_duplicates(odd, words=3, similarity=None).collect()
    values = {r["fp"] & (2**64 - 1) for r in got}
    roots = linked(values, 2)
    least = {}
    for r in got:
        root = roots[r["fp"] & (2**64 - 1)]
        least[root] = min(x for x in (least.get(root), r["doc_id"]) if x is not None) if (least.get(root), r["doc_id"]) != (None, None) else None
    assert len(got) == odd.count() and all(r["component_id"] == least[roots[r["fp"] & (2**64 - 1)]] for r in got)


@pytest.mark.parametrize("hubs, spread", [(0, 3), (0, 12), (4, 12), (0, 40)])
def test_a_crowd_in_one_band_is_linked_exactly(spark, monkeypatch, hubs, spread):
    """Whatever the hubs find, no pair across components is lost: tight crowds, loose ones, two centres, strangers."""
    monkeypatch.setattr(simhash, "HUBS", hubs)
    rng = random.Random(spread)
    bases = [list(range(b * 1000, b * 1000 + 100)) for b in (1, 2)]
    bases.append(bases[0][:75] + list(range(5000, 5030)))
    sets = []
    for k in range(90):
        base = set(rng.choice(bases))
        for _ in range(rng.randrange(spread)):
            base.discard(rng.choice(sorted(base)))
            base.add(rng.randrange(10**6, 10**9))
        sets.append(frozenset(base))
    sets += [frozenset(rng.sample(range(10**9), 40)) for _ in range(5)] + [frozenset([1]), frozenset()]
    sets = list(dict.fromkeys(sets))
    want = unite(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if similar(sets[a], sets[b])])
    known = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "node long, shingles array<long>")
    nodes = spark.createDataFrame([(k, [7, 1000 + k % 3]) for k in range(len(sets))], "node long, keys array<long>")
    none = spark.createDataFrame([], "src long, dst long")
    got = {r["node"]: r["root"] for r in simhash.similar_components(nodes, none, lambda wanted: known.join(wanted, "node"), 0.8, bucket=1).collect()}
    assert [got.get(k, k) for k in range(len(sets))] == want


@pytest.mark.parametrize("everywhere", [True, False])
def test_a_crowd_in_many_bands_is_described_once(spark, monkeypatch, everywhere):
    """Bands that hold much the same nodes, each under a least node of its own, cost one row a node, and no pair of a band is lost."""
    monkeypatch.setattr(simhash, "HUBS", 0)
    rng = random.Random(everywhere)
    bases = [list(range(b * 1000, b * 1000 + 100)) for b in (1, 2)]
    sets = []
    for _ in range(120):
        base = set(rng.choice(bases))
        for _ in range(rng.randrange(30)):
            base.discard(rng.choice(sorted(base)))
            base.add(rng.randrange(10**6, 10**9))
        sets.append(frozenset(base))
    keys = [[1] * everywhere + [100 + b if k >= b and rng.random() < 0.8 else 1000 * (b + 1) + k for b in range(12)] for k in range(120)]
    close = [(a, b) for a in range(120) for b in range(a) if similar(sets[a], sets[b])]
    known = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "node long, shingles array<long>")
    nodes = spark.createDataFrame(list(enumerate(keys)), "node long, keys array<long>")
    none, sizes, real = spark.createDataFrame([], "src long, dst long"), [], simhash.durable

    def counting(df, label, *more):
        out = real(df, label, *more)
        if label == "sides":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "durable", counting)
    got = {r["node"]: r["root"] for r in simhash.similar_components(nodes, none, lambda wanted: known.join(wanted, "node"), 0.8, bucket=1).collect()}
    least, most = unite(120, [(a, b) for a, b in close if any(x == y for x, y in zip(keys[a], keys[b], strict=True))]), unite(120, close)
    found = [got.get(k, k) for k in range(120)]
    assert all(found[k] == found[least[k]] and most[k] == most[found[k]] for k in range(120))
    assert len(sizes) == 1 and sizes[0] <= 1.1 * 120


@pytest.mark.parametrize("stranger, most", [(False, 1), (True, 4)])
def test_a_crowd_has_few_edges_between_its_roots(spark, monkeypatch, stranger, most):
    """A crowd in many bands gives components no more edges than nodes, or than a hub or two a node if its least node is a stranger to all."""
    rng = random.Random(6)
    sets = [frozenset(range(100)) | frozenset(10**6 * (k + 1) + x for x in range(rng.randrange(1, 12))) for k in range(120)]
    sets += [frozenset(range(20, 90 - 2 * k)) for k in range(9)]  # linked to one another and to none of the crowd
    sets[0] = frozenset([1]) if stranger else sets[0]
    n = len(sets)
    close = [(a, b) for a in range(n) for b in range(a) if similar(sets[a], sets[b])]
    known = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "node long, shingles array<long>")
    nodes = spark.createDataFrame([(k, [0, *(100 + b if k >= b and rng.random() < 0.8 else 1000 * (b + 1) + k for b in range(12))]) for k in range(n)], "node long, keys array<long>")
    none, sizes, real = spark.createDataFrame([], "src long, dst long"), [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: sizes.append(edges.count()) or real(edges))
    got = {r["node"]: r["root"] for r in simhash.similar_components(nodes, none, lambda wanted: known.join(wanted, "node"), 0.8).collect()}
    assert [got.get(k, k) for k in range(n)] == unite(n, close)
    assert sizes and max(sizes) <= most * n < len(close)


def test_keep_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) == len(set(rows)) and {1} == {i for i, _ in rows} & {1, 2, 3}
    assert sorted(r[1] for r in rows if r[0] == 10)[0].startswith("another")
    rng = random.Random(4)
    base = prose(rng, 400)
    docs = frame(spark, [(k, base if k % 3 else base.upper(), "en", "a") for k in range(9, 2, -1)] + [(90, prose(rng, 400), "en", "a")])
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {3, 90}
    assert simhash.keep_one(odd.limit(0)).count() == 0
    clash = ("id", "gone", "again", "node", "fp", "n", "list")
    named = odd.select("*", *(F.lit(c).alias(c) for c in clash)).withColumnRenamed("doc_id", "component_id")
    again = simhash.keep_one(named, id_col="component_id")
    assert again.columns == named.columns and sorted(map(str, ((r["component_id"], r["text"]) for r in again.collect()))) == sorted(map(str, rows))


def test_near_duplicates_reach_similar_shingle_sets(spark):
    """All pairs at a Jaccard similarity of 0.8 over five-word shingles, none below, also in a crowd that shares its bands."""
    rng = random.Random(14)
    texts = []
    for group in range(30):
        words = prose(rng, 200).split()
        for _ in range(60 if group == 0 else 4):
            copy = list(words)
            for at in rng.sample(range(200), rng.randrange(1, 4 if group == 0 else 8)):
                copy[at] = f"changed{rng.random()}"
            texts.append(" ".join(copy))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for t in texts]
    root = unite(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if similar(sets[a], sets[b])])
    assert len(set(root)) <= len(texts) - 70
    docs = frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == dict(enumerate(root))
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(root)


def test_leaks(spark):
    rng = random.Random(6)
    items = [(k, " ".join(prose(rng, n, [f"w{k}x{j}" for j in range(200)]).split())) for k, n in enumerate((15, 25, 57, 8, 3))]
    bench = spark.createDataFrame([*items, (7, items[1][1]), (None, items[0][1]), (9, None), (10, "")], "item_id long, text string")
    clean = [(k, prose(rng, 300), "en", "a") for k in range(5)]
    words = [items[k][1].split() for k in range(5)]
    swapped = ["zzz" if k in (3, 9, 20) else w for k, w in enumerate(words[1])]
    rows = [
        (100, prose(rng, 50) + "\n" + items[0][1].upper() + "! " + prose(rng, 50), "en", "a"),
        (101, prose(rng, 50) + " " + " ".join(swapped) + " " + prose(rng, 9), "en", "a"),
        (102, " ".join(words[2][10:40]), "en", "a"),
        (103, items[3][1], "en", "a"),
        (104, items[4][1], "en", "a"),
        (105, " ".join(words[2][:8]), "en", "a"),
        (106, None, "en", "a"),
        (107, " ".join(words[0][:7]), "en", "a"),
        (108, " ".join(words[0][7:]), "en", "a"),
        (None, items[0][1], "en", "a"),
    ]
    docs = frame(spark, clean + rows)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_overlaps(docs, bench).collect()}
    assert set(got) == {(100, 0), (101, 1), (102, 2), (103, 3), (104, 4), (None, 0)}
    longer = decontaminate.find_overlaps(docs, bench, shortest=5)
    assert {(r["doc_id"], r["item_id"]) for r in longer.collect()} == set(got) - {(104, 4)}
    r = got[101, 1]
    assert (r["matched"], r["overlap"], r["item_words"], r["start_word"], r["stop_word"]) == (22, 25, 25, 50, 75)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 3, 4, 105, 106, 107, 108}
    in_blocks = decontaminate.find_overlaps(docs, bench, block_words=30)
    assert {(r["doc_id"], r["item_id"]) for r in in_blocks.collect()} == set(got)
    assert decontaminate.find_overlaps(docs.limit(0), bench).count() == 0
    assert decontaminate.find_overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_leaks_found_as_by_brute_force():
    """Random substitutions: whatever an overlay of every item at every place finds, the seeds find nearly always."""
    rng = random.Random(8)
    vocabulary = [rng.getrandbits(64) for _ in range(5000)]
    items = [(k, np.array([rng.choice(vocabulary) for _ in range(30)], np.uint64)) for k in range(5)]
    block = decontaminate.Block(items)
    met = missed = 0
    for _ in range(200):
        item = items[rng.randrange(5)][1].copy()
        for k in range(30):
            if rng.random() < 0.15:
                item[k] = rng.getrandbits(64)
        around = lambda: np.array([rng.choice(vocabulary) for _ in range(20)], np.uint64)
        text = np.concatenate((around(), item, around()))
        exact = {i for i, w in items for at in range(len(text) - 29) if (lambda s: s[2] >= 13 and s[2] >= 0.7 * (s[1] - s[0]))(decontaminate.best_stretch(text[at : at + 30] == w))}
        found = {g[1] for g in block.search(text, np.array([0, len(text)]), 13, 0.7, 0.7)}
        assert found <= exact
        met, missed = met + len(found), missed + len(exact - found)
    assert met > 150 and missed <= 0.02 * met


def test_stretches_are_found_as_by_brute_force():
    rng = np.random.default_rng(15)
    shapes = [np.repeat([True, False, True], sizes) for sizes in ((40, 37, 40), (13, 12, 13), (20, 1, 20))]
    shapes += [np.arange(n) % 3 != 2 for n in (20, 21, 23, 24, 30, 40, 59)]
    shapes += [rng.random(rng.integers(1, 45)) < rng.choice([0.0, 0.5, 0.7, 0.9, 1.0]) for _ in range(60)]
    for same in shapes:
        within = [(int(same[a:b].sum()), a - b, -a) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if 10 * same[a:b].sum() >= 7 * (b - a)]
        matched, size, start = max(within, default=(0, 0, 0))
        assert decontaminate.best_stretch(same) == (-start, -start - size, matched)


def test_long_overlaps_with_a_substituted_middle():
    words = np.random.default_rng(16).integers(0, 2**64, 117, dtype=np.uint64)
    for item, kept in ((words, np.repeat([True, False, True], (40, 37, 40))), (words[:38], np.repeat([True, False, True], (13, 12, 13))), (words[:59], np.arange(59) % 3 != 2)):
        text = np.where(kept, item, item + np.uint64(1))
        got = list(decontaminate.Block([(1, item)]).search(text, np.array([0, len(text)]), 13, 0.7, 0.7))
        assert [g[1] for g in got] == [1] and got[0][2] >= 13


def test_every_overlay_within_the_limits_has_a_hit():
    """The most words that can match without a hit, by length, stay below the limits; also short items with substitutions."""
    for masks, lengths in ((decontaminate.LIGHTEST, range(5, 15)), (decontaminate.LIGHT, range(15, 200))):
        codes, most, by_length = [int(m, 2) for m in masks], {0: 0}, [0]
        for _ in range(max(lengths)):
            then = {}
            for state, n in most.items():
                for bit in (0, 1):
                    seen = state << 1 | bit
                    if all(seen & c != c for c in codes):
                        then[seen & 255] = max(then.get(seen & 255, 0), n + bit)
            most = then
            by_length.append(max(most.values()))
        for n in lengths:
            assert not [k for k in range(1, n + 1) if by_length[k] >= min(13, 0.7 * n) and 10 * by_length[k] >= 7 * k]
    rng = random.Random(17)
    for n in [*range(5, 21)] * 12:
        item = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        kept = np.ones(n, bool)
        kept[rng.sample(range(n), n - max(-(-7 * n // 10), 1))] = False
        text = np.concatenate((item[::-1], np.where(kept, item, item + np.uint64(1)), item[::-1]))
        got = list(decontaminate.Block([(1, item)]).search(text, np.array([0, len(text)]), 13, 0.7, 0.7))
        assert bool(got) == (decontaminate.best_stretch(kept)[2] >= min(13, 0.7 * n))
    for n in range(1, 5):
        item = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        got = list(decontaminate.Block([(1, item)], shortest=1).search(np.concatenate((item[:1], item)), np.array([0, n + 1]), 13, 0.7, 0.7))
        assert [g[1] for g in got] == [1]


def test_items_without_an_id(spark):
    rng = random.Random(18)
    words = [f"w{k}" for k in range(200)]
    first, second = prose(rng, 20, words), prose(rng, 20, words)
    bench = spark.createDataFrame([(None, first), (None, first), (3, second)], "item_id long, text string")
    docs = frame(spark, [(1, first, "en", "a"), (2, second, "en", "a"), (3, prose(rng, 50, ["other"]), "en", "a")])
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_overlaps(docs, bench).collect()} == {(1, None), (2, 3)}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()] == [3]


def test_hits_come_in_bounded_pieces(monkeypatch):
    """A seed that many items share is expanded a piece at a time; all of its matches come."""
    monkeypatch.setattr(tokens, "CHUNK", 50)
    seeds = np.full(300, 7 << 60, np.uint64)
    table = tokens.SeedTable(seeds, np.arange(300), np.zeros(300, np.int64))
    got = list(table.hits(np.array([7 << 60, 5, 7 << 60], np.uint64)))
    assert sorted(zip(*map(np.ndarray.tolist, (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))), strict=True)) == [(k, t) for k in (0, 2) for t in range(300)]
    assert all(len(g[0]) <= 300 for g in got) and len(got) == 2


def test_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 10)
    offsets = np.array([0, 4, 8, 40, 41, 41, 50])
    assert list(tokens.pieces(offsets)) == [(0, 2), (2, 3), (3, 6)]
    assert list(tokens.pieces(np.array([0]))) == []


def test_licenses(spark, odd):
    rng = random.Random(9)
    mit = license_scan.TEMPLATES["MIT-text"]
    changed = mit.replace("without restriction", "with no restriction at all").replace("sublicense,", "")
    rows = [(1, prose(rng, 40) + "\nReleased under the  MIT license!\n" + prose(rng, 40) + " released under the MIT License", "en", "a"), (2, "é " + changed, "en", "a"), (3, "Released under the License of MIT somebody", "en", "a"), (4, mit[: len(mit) // 2], "en", "a"), (5, prose(rng, 200), "en", "a")]
    docs = frame(spark, rows)
    got = {(r["doc_id"], r["license"]): r for r in license_scan.scan_licenses(docs).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT-text")}
    spans = [rows[0][1][s["start_char"] : s["stop_char"]] for s in got[1, "MIT"]["spans"]]
    assert spans == ["Released under the  MIT license", "released under the MIT License"] and got[1, "MIT"]["coverage"] == 1.0
    (span,) = got[2, "MIT-text"]["spans"]
    assert 0.9 < got[2, "MIT-text"]["coverage"] < 1.0 and span["start_char"] == 2 and span["start_word"] == 1
    assert license_scan.scan_licenses(odd).count() == 0
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan_licenses(docs, {"x": "two words"})


@pytest.mark.parametrize("name", ["MIT", "CC-BY-NC-4.0", "Apache-2.0"])
@pytest.mark.parametrize("copies", [2, 6])
def test_notices_on_consecutive_lines(name, copies):
    words = [w.lower() for w in license_scan.WORD.findall(license_scan.TEMPLATES[name])]
    hashed = lambda ws: np.array([xxhash.xxh64_intdigest(w, seed=42) for w in ws], np.uint64)
    scanner = license_scan.Scanner([name], [hashed(words)], 0.8)
    text = hashed(["before", *words * copies, "after"])
    (found,) = scanner.scan(text, np.array([0, len(text)]))[0]
    n = len(words)
    assert found == (0, 1.0, [(n, 1 + k * n, 1 + (k + 1) * n) for k in range(copies)])


def test_altered_notices_are_found():
    """Templates with a tenth of the words substituted or left out, among other words: nearly all are found, with their spans."""
    rng = random.Random(21)
    names = sorted(license_scan.TEMPLATES)
    code = {}
    words = [np.array([code.setdefault(w.lower(), rng.getrandbits(64)) for w in license_scan.WORD.findall(license_scan.TEMPLATES[n])], np.uint64) for n in names]
    scanner = license_scan.Scanner(names, words, 0.8)
    tried = found = 0
    for t, w in enumerate(words):
        for _ in range(6):
            altered, matched = [], 0
            for x in w.tolist():
                fate = rng.random()
                matched += fate >= 0.1
                altered += [x] if fate >= 0.1 else [rng.getrandbits(64)] if fate < 0.05 else []
            if matched < 0.84 * len(w):
                continue
            before, after = ([rng.getrandbits(64) for _ in range(rng.randrange(60))] for _ in range(2))
            text = np.array([*before, *altered, *after], np.uint64)
            got = {k: spans for k, _, spans in scanner.scan(text, np.array([0, len(text)])).get(0, [])}
            tried += 1
            found += t in got and abs(got[t][0][1] - len(before)) <= 3 and abs(got[t][0][2] - len(before) - len(altered)) <= 3
    assert tried > 60 and found / tried >= 0.9


def test_banded_alignment_equals_a_full_one():
    """Within the band, the best local alignment's score by the full table."""
    rng = random.Random(3)

    def full(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    for _ in range(60):
        a = tuple(rng.randrange(4) for _ in range(rng.randrange(3, 12)))
        b = tuple(rng.randrange(4) for _ in range(rng.randrange(3, 12)))
        matched, start, stop = license_scan.align(a, b, 0, 20)
        assert 0 <= start <= stop <= len(b) and (matched == 0) == (full(a, b) == 0)
        assert full(a, b[start:stop]) == full(a, b)


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50):
        hashes = rng.integers(0, 9, n).astype(np.uint64)
        kept = license_scan.winnow(hashes, 4)
        windows = [hashes[k : k + 4] for k in range(max(1, n - 3))]
        assert all(any(k <= p < k + 4 and hashes[p] == w.min() for p in kept) for k, w in enumerate(windows))


def labelled(spark, n, toxic_word):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(n):
        bad, junk = rng.random() < 0.2, rng.random() < 0.2
        text = prose(rng, rng.randrange(60, 200))
        text = text + f" {toxic_word}{rng.choice(['ung', 'er', 'en'])} " + prose(rng, 20) if bad else text
        text = " ".join(w.upper() + "!!" for w in text.split()) if junk else text
        rows.append((k, text, "en", "a"))
        if k % 2:
            labels.append((k, int(not junk), int(bad)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


@pytest.fixture(scope="module")
def learnt(spark):
    return labelled(spark, 900, "schurk")


def held(i, folds, k):
    return zlib.crc32(str(i).encode()) % folds == k


def test_toxicity(learnt, odd):
    docs, labels, rows = learnt
    got = toxicity.score_toxicity(docs, labels).collect()
    truth = {k: "schurk" in t.lower() for k, t, _, _ in rows}
    assert len(got) == len(rows) and all(r["held_out"] == held(r["doc_id"], 4, 2) for r in got)
    right = [(r["score"] >= 0.3) == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(right) / len(right) > 0.95
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.score_toxicity(docs, flipped).collect() == got, "held-out labels must not matter"
    scores = {r["score"] for r in toxicity.score_toxicity(odd, labels).collect()}
    assert all(0 <= s <= 1 for s in scores)
    assert {r["score"] for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def packed(texts):
    return np.concatenate([np.empty(0, np.int32), *texts]).astype(np.int32), np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)


def plain_risk(w, b, toxic, rest, prior):
    """The non-negative risk, text by text."""
    score = lambda x: 1 / (1 + np.exp(-(b + sum(w[k] for k in x))))
    loss_toxic = sum(1 - score(x) for x in toxic) / len(toxic)
    clean = sum(score(x) for x in rest) / len(rest) - prior * sum(score(x) for x in toxic) / len(toxic)
    return prior * loss_toxic + max(0, clean), clean


@pytest.mark.parametrize("prior", [0.05, 0.99])
def test_risk_and_its_gradient(prior):
    """Against a plain sum and numeric slopes, with the clean part above and below zero."""
    rng = np.random.default_rng(int(prior * 100))
    toxic, rest = ([sorted(rng.choice(5, rng.integers(0, 4), replace=False).tolist()) for _ in range(n)] for n in (12, 40))
    kinds = sorted({tuple(x) for x in rest})
    rows = toxicity.Rows(*packed([np.array(x) for x in kinds]), np.array([sum(tuple(x) == k for x in rest) for k in kinds], float))
    bad = toxicity.Rows(*packed([np.array(x) for x in toxic]), np.ones(12))
    signs = set()
    for b in (-1.0, 0.5, 0.0, 1.0):
        w = rng.normal(size=5)
        value, clean, grad = toxicity.risk(w, b, bad, rows.terms, 40, prior)
        assert np.allclose((value, clean), plain_risk(w, b, toxic, rest, prior))
        signs.add(clean >= 0)
        part = (lambda w, b: plain_risk(w, b, toxic, rest, prior)[0]) if clean >= 0 else (lambda w, b: -plain_risk(w, b, toxic, rest, prior)[1])
        h = 1e-6
        slopes = [(part(w + h * np.eye(5)[k], b) - part(w - h * np.eye(5)[k], b)) / (2 * h) for k in range(5)]
        assert np.allclose(grad, [*slopes, (part(w, b + h) - part(w, b - h)) / (2 * h)], atol=1e-6)
    assert signs == {True} if prior < 0.5 else False in signs


def cue_texts(n, m, share, seed=2):
    """Toxic texts share one cue; ``share`` of the unlabelled ones are toxic too."""
    rng = np.random.default_rng(seed)
    text = lambda bad: np.concatenate((rng.integers(10, 5000, 40), [7] if bad else [])).astype(np.int32)
    return [text(True) for _ in range(n)], [text(k < share * m) for k in range(m)]


def test_toxicity_does_not_take_unlabelled_toxic_texts_for_clean(spark, monkeypatch):
    toxic, rest = cue_texts(200, 800, 0.25)
    counts = lambda x: np.bincount(np.concatenate(x), minlength=1 << toxicity.BITS)
    codes = toxicity.lifted(counts(toxic), 200, counts(rest), 800, 4000)
    assert 7 in codes
    bad = toxicity.Rows(*toxicity._reduced(*packed(toxic), codes), np.ones(200))
    places, offsets = toxicity._reduced(*packed(rest), codes)
    frame = spark.createDataFrame([(places[a:b].tolist(),) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], "places array<int>").groupBy("places").agg(F.count("*").alias("n"))
    model = toxicity.fit(codes, bad, toxicity._Patterns(frame, len(codes)), 800, counts(rest)[codes], None)
    assert 0.2 < model.prior < 0.33
    score = lambda texts: model.scores(*toxicity._reduced(*packed(texts), codes))
    assert score(cue_texts(50, 0, 0, 3)[0]).min() > 0.5 and score(cue_texts(0, 50, 0, 4)[1]).max() < 0.3
    monkeypatch.setattr(toxicity, "LOCAL_PATTERNS", 0)
    spread = toxicity._Patterns(frame, len(codes))
    w = np.linspace(0, 1, len(codes))
    local = toxicity.Rows(places, offsets, np.ones(800))
    assert spread.rows is None and np.allclose(spread.terms(w, -1.0), local.terms(w, -1.0))
    assert np.allclose(spread.scored(w, np.array([-1.0, 0.0])), [toxicity._squash(local.logits(w, b)).sum() for b in (-1.0, 0.0)])
    assert np.allclose(spread.reaching(w, np.array([0.1])), [(local.logits(w, 0.0) >= 0.1).sum()])


def test_samples_may_be_tiny_shares(spark):
    ids = spark.range(200_000).select(F.col("id"))
    for share in (1e-3, 1e-5):
        got = [r["id"] for r in hash_sample(ids, "id", share, 3).collect()]
        assert abs(len(got) - 200_000 * share) < 6 * (200_000 * share + 1) ** 0.5
    bound = ids.select(F.expr("1").alias("one"), chosen(F.col("id"), 9000 / 10**10, 1).alias("x"))
    assert str(int(9000 / 10**10 * 2**63))[:6] in bound._jdf.queryExecution().optimizedPlan().toString().replace("L", "")
    assert hash_sample(ids, "id", 1.0, 3).count() == 200_000 and ids.where(chosen(F.col("id"), F.lit(1.0), 3)).count() == 200_000


def test_quality_model(learnt, odd):
    docs, labels, rows = learnt
    got = quality_model.score_quality(docs, labels).collect()
    truth = {k: "!!" not in t for k, t, _, _ in rows}
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) for r in got)
    right = [(r["score"] >= 0.3) == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in quality_model.score_quality(odd, labels).collect())
    assert {r["score"] for r in quality_model.score_quality(odd, labels.where("quality = 1 and doc_id < 0")).collect()} == {0.5}
    assert quality_model.score_quality(docs.limit(0), labels).count() == 0
    kept = quality_model.keep_good(docs, labels)
    assert kept.columns == docs.columns
    wrong = {r["doc_id"] for r in kept.collect()} ^ {k for k, good in truth.items() if good}
    assert len(wrong) < 0.03 * len(rows)


def test_quality_scores_equal_the_densities():
    rng = np.random.default_rng(5)
    x = [rng.normal(0, 1, (300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]]), rng.normal(1, 0.5, (200, 3))]

    class Rows:
        def groupBy(self, _):
            return self

        def agg(self, *_):
            return self

        def collect(self):
            out = []
            for y in (0, 1):
                row = {"y": y, "n": len(x[y])} | {f"s{i}": x[y][:, i].sum() for i in range(3)}
                out.append(row | {f"c{i}_{j}": (x[y][:, i] * x[y][:, j]).sum() for i in range(3) for j in range(i, 3)})
            return out

    model = quality_model.train(Rows(), 3, 0.0, 0.0)
    point = np.array([[0.3, -0.2, 0.7]])
    logs = []
    for y in (0, 1):
        c, d = np.cov(x[y].T, bias=True), (point - x[y].mean(0))[0]
        logs.append(np.log(len(x[y]) / 500) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * d @ np.linalg.inv(c) @ d)
    assert np.allclose(model.scores(point), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_languages(spark, odd):
    rng = random.Random(12)
    kinds = {"en": "the of and to with this that from were".split(), "de": "der die und nicht sich auch werden zwischen".split(), "fr": "les des une dans pour avec être après".split()}
    rows = [(k, prose(rng, 50, kinds[lang]), lang if k % 10 else None, "a") for k, lang in enumerate(sorted(kinds) * 60)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert all(r["held_out"] == held(i, 4, 2) for i, r in got.items())
    truth = {k: lang for k, lang in enumerate(sorted(kinds) * 60)}
    out = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in out) / len(out) > 0.95
    mixed = language_id.identify(docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("lang", F.lit(None).cast("string")))).where("doc_id > 1000").collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in mixed}
    assert by[1001] == by[1002] == by[1003] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in by.values()) and by[1006][0] == "en"
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_ranks_by_brute_force():
    rng = random.Random(13)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(300))
    counts = {}
    for word in text.split():
        padded = f" {word} "
        for n in (1, 2, 3):
            for k in range(len(padded) - n + 1):
                g = padded[k : k + n]
                if g.strip():
                    counts[g] = counts.get(g, 0) + 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    # n-grams span one word: the blank between two words pads both
    inside = {code(g): n for g, n in counts.items()}
    codes, found = language_id.grams_of(text)
    got = {int(c): int(n) for c, n in zip(codes, found, strict=True)}
    across = {c for c in got if (c >> 42) and ((c >> 21) & 0x1FFFFF) == 32}
    assert {c: n for c, n in got.items() if c not in across and c >> 42} == {c: n for c, n in inside.items() if c >> 42}
    top = language_id.ranked(codes, found, 20)
    assert list(top) == [c for c, _ in sorted(got.items(), key=lambda x: (-x[1], x[0]))[:20]]


def test_mixing(spark, odd):
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"), F.when(F.col("id") % 4 == 0, "small").otherwise("large").alias("source"), F.lit("taken").alias("replica"))
    got = mixing.mix(docs, weights={"small": 1.0, "large": 1.0, "absent": 5.0}, total=2.0)
    assert got.columns == [*docs.columns, "replica_", "shuffle_key"]
    sizes = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(sizes["small"] - n) < 4 * n**0.5 and abs(sizes["large"] - n) < 4 * n**0.5
    copies = {r["doc_id"]: r["count"] for r in got.where("source = 'small'").groupBy("doc_id").count().collect()}
    values = np.array([copies.get(i, 0) for i in range(0, n, 4)])
    assert abs(values.mean() - 4) < 0.3 and abs(values.var() - 4) < 0.8, "a mean of four copies, Poisson variance"
    keys = [r["shuffle_key"] for r in got.select("shuffle_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert [r["doc_id"] for r in got.limit(20).collect()] == [r["doc_id"] for r in mixing.mix(docs, weights={"small": 1.0, "large": 1.0}, total=2.0).limit(20).collect()]
    only = mixing.mix(docs, weights={"small": 1.0})
    assert {r["source"] for r in only.select("source").distinct().collect()} == {"small"}
    assert set(mixing.mix(odd).columns) == {*odd.columns, "replica", "shuffle_key"}
    assert mixing.mix(odd.limit(0)).count() == 0


def test_large_rates_are_drawn_in_parts(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.lit("s").alias("source"))
    n = mixing.mix(docs, total=80.0).count()
    assert abs(n - 24_000) < 5 * 24_000**0.5


def test_distribution_is_poisson(spark):
    from math import exp, factorial

    for mean in (0.0, 0.3, 4.0, 31.5):
        got = spark.range(1).select(mixing._distribution(F.lit(mean)).alias("c")).first()["c"]
        want = np.cumsum([exp(-mean) * mean**k / factorial(k) for k in range(111)])
        assert np.allclose(got, want[: len(got)], atol=1e-12) and (len(got) == 111 or want[len(got)] > 1 - 1e-14)


def test_a_text_of_a_million_words(spark):
    """Nothing is cut: measures, fingerprint, notices, leaks, language and scores heed the last words as well."""
    rng = random.Random(21)
    words = [f"w{rng.randrange(400_000)}" for _ in range(1_000_000)]
    notice, item = "Released under the MIT License.", "one rare passage that ends the text and stands nowhere else in it at all"
    text = " ".join(words) + f"\n{notice}\n{item}"
    docs = frame(spark, [(1, text, "en", "a"), (2, prose(rng, 80), "en", "a"), (3, "", None, None)])
    got = {r["row"]["doc_id"]: r for r in quality_rules.score_rules(docs).collect()}[1]
    every = WORD.findall(text)
    grams = list(zip(every, every[1:], every[2:], strict=False))
    often = Counter(grams)
    again = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    assert tuple(got["measures"][:5]) == (len(every), sum(map(len, every)), 0, 0, len(again))
    totals = np.zeros(64, np.int64)
    for g in grams:
        totals += np.unpackbits(np.array([xxhash.xxh64_intdigest(" ".join(g).lower(), 42)], ">u8").view(np.uint8))
    want = sum(1 << (63 - k) for k in range(64) if 2 * totals[k] > len(grams))
    prints = {r["doc_id"]: r["fp"] for r in simhash.near_duplicates(docs, words=3, similarity=None).collect()}
    assert prints[1] % (1 << 64) == want
    found = license_scan.scan_licenses(docs).collect()
    assert [(r["doc_id"], r["license"], r["spans"][0]["stop_word"]) for r in found] == [(1, "MIT", 1_000_005)]
    leaks = decontaminate.find_overlaps(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["matched"], r["stop_word"]) for r in leaks] == [(1, 7, len(item.split()), len(every))]
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}[1] == "en"
    labels = spark.createDataFrame([(k, 1, 0) for k in (1, 2, 3)], "doc_id long, quality int, toxic int")
    assert quality_model.score_quality(docs, labels).count() == toxicity.score_toxicity(docs, labels).count() == 3
