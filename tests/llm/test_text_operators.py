"""Text operators against brute force on small tables with nulls, empty and long texts, ties, copies and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from sevspark.llm import (  # noqa: E402
    components, fingerprints, hamming, jaccard_join, language, licenses, mixing, packing, queries, recompression, token_counts, toxicity,
)
from sevspark.llm.common import RunHash, Words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ord string, tid string, key string, size string"


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ré", "tu", "ß", "x"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(120), prose(60)
    near = base.split()
    near[60] = "changed"
    return [
        base, base, " ".join(near), base.upper(), "", None, " \n\t ", "one two three", "One  two\nthree", "a " * 90, "b\n" * 90,
        prose(200) + " " + passage, passage + " " + prose(50), passage, prose(5000), "x" * 30_000, "don't <|endoftext|> ▁ a▁b  <0x0A>. ok., …",
        base + " " + base, prose(19), prose(20), "日本語 テキスト \x00   nb sp",
    ]


def table(spark, rows=None):
    rows = [(i * 7 % 50, t) for i, t in enumerate(texts())] + [(None, "null id text " * 30), (None, "null id text " * 30)] if rows is None else rows
    full = [(i, t, None if i == 7 else "xx", [None, "s1", "s2"][(i or 0) % 3], None, "o", "t", "k", "z") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def empty(spark):
    return table(spark, [])


def test_words_and_runs():
    w = Words(["ab  cd", None, "", "ab"])
    assert np.diff(w.at).tolist() == [2, 0, 0, 1] and w.hash[0] == w.hash[2] != w.hash[1]
    runs = RunHash(np.array([3, 5, 3, 5, 9], np.uint64))
    assert runs(np.array([0]), np.array([2])) == runs(np.array([2]), np.array([4]))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, None)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(links.where("false")).count() == 0


def test_token_counts(spark, docs, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = token_counts.processor(path)
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows)
    got = token_counts.token_counts(docs, path).collect()
    assert sorted((-1 if r.id is None else r.id, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_token_counts_of_hashes_that_share_their_low_half(spark, monkeypatch):
    """Texts without an id are told apart by the whole 64-bit hash."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts_ = ["one", "one two three four five"]
    frame = spark.createDataFrame([(None, t) for t in texts_], "doc_id long, text string")
    real = token_counts.ranked
    low = F.when(F.col("text") == "one", F.lit(1)).otherwise(F.lit((5 << 32) + 1)).cast("bigint")
    monkeypatch.setattr(token_counts, "ranked", lambda *a: real(*a).withColumn("tid", low))
    got = token_counts.token_counts(frame, path).collect()
    assert sorted(x.n_bytes for x in got) == [3, 23] and len({x.n_tokens for x in got}) == 2


def test_token_counts_send_a_pre_token_of_a_slice_once(spark, monkeypatch):
    """Pre-tokens that are not hot travel once for a slice, whatever number of its texts has them."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = token_counts.processor(path)
    numbers = [2**32 - 1, 0, 1, 70_000]
    assert token_counts.numbers(token_counts.planes(np.array(numbers))).tolist() == numbers
    monkeypatch.setattr(token_counts, "hot_counts", lambda *a: (np.empty(0, np.uint64), np.empty(0, np.int64)))
    words = " ".join("w%dx\nyé" % i for i in range(300))
    frame = spark.createDataFrame([(i if i % 3 else None, words + " end%d" % (i % 7)) for i in range(200)] + [(2**63 - 1, None)], "doc_id long, text string")
    counts = token_counts.token_counts(frame.coalesce(1), path)
    got = sorted((-1 if x.id is None else x.id, x.n_bytes, x.n_tokens) for x in counts.collect())
    want = [(-1 if i is None else i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in frame.collect()]
    assert got == sorted(want) and got[-1] == (2**63 - 1, 0, 0)
    plan = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "token#" not in plan and plan.count("MapInArrow") == 3


def test_license_scan(spark):
    notice = dict(licenses.NOTICES)
    found = table(spark, [
        (1, "text before. " * 40 + notice["mit"] + " and after" * 500), (2, notice["gpl-3.0"].upper()), (3, "under the license"), (4, None), (5, ""),
        (6, "this work is licensed under gnu general public license version 3"), (7, notice["apache-2.0"] + "\n" + notice["cc-by-nc-4.0"]),
    ])
    templates = spark.createDataFrame(licenses.NOTICES + [("none", ""), ("nil", None)], "template string, text string")
    got = {(r.id, r.template) for r in licenses.license_scan(found, templates).collect()}
    assert got == {(1, "mit"), (2, "gpl-3.0"), (7, "apache-2.0"), (7, "cc-by-nc-4.0")}
    assert licenses.license_scan(empty(spark), templates).count() == 0
    assert licenses.license_scan(found, templates.where("false")).count() == 0


def test_license_scan_finds_every_line_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {(r.doc_id, r.template) for r in queries.op2_license_scan(spark, "/root/testdata/sf0.001").collect()}
    want = {(r.doc_id, k) for k, line in licenses.NOTICES for r in docs.where(F.col("text").contains(line)).collect()}
    assert want and want <= got


def test_hamming_top_k(spark):
    r = random.Random(2)
    some = [[r.getrandbits(16) & 0xFF, r.getrandbits(3)] for _ in range(60)]
    data = [(i, c) for i, c in enumerate(some + some[:5] * 20)] + [(None, [0, 0]), (999, None)]
    frame = spark.createDataFrame(data, "id long, code array<int>")
    got = defaultdict(list)
    for x in hamming.nearest_codes(frame, frame.where("id % 50 = 0"), 4, 2).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.distance, x.id))
    for q, code in data:
        if q is not None and code and q % 50 == 0:
            far = sorted((sum((a ^ b).bit_count() for a, b in zip(code, c)), i) for i, c in data if c and i is not None and i != q)
            assert got[q] == far[:4]
    assert hamming.nearest_codes(frame.where("false"), frame.where("false"), 4, 2).count() == 0


def test_hamming_top_k_of_repeated_rows(spark):
    """Copies of a row take no places of other ids, neither of one code nor as queries."""
    data = [(2, [7])] * 12 + [(0, [7])] * 3 + [(i, [7]) for i in (5, 6, 7, 8)] + [(9, [6])]
    frame = spark.createDataFrame(data, "id long, code array<int>")
    got = hamming.nearest_codes(frame, frame.where("id = 0"), 4, 1).orderBy("rank").collect()
    assert [(x.rank, x.id, x.distance) for x in got] == [(1, 2, 0), (2, 5, 0), (3, 6, 0), (4, 7, 0)]


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    path, capacity = public_tokenizers.path("word_bpe_49k.json"), 64
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, "doc_id", "text", path, capacity, 0).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p.id, p.tid].append((p.piece, p.start, p.length, bytes(p.ids)))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    want = Counter()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), capacity):
            want[i, k // capacity, k, ids[k : k + capacity].tobytes()] += 1
    assert Counter((p.id, p.piece, p.start, bytes(p.ids)) for p in got) == want
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(p.length for p in got)
    assert len(by_sequence) <= -(-total // capacity) + 3
    assert packing.pack(empty(spark), "doc_id", "text", path, capacity, 0).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_count_once(seed):
    r = random.Random(seed)
    capacity = r.choice([5, 60, 2048])
    counts = {n: r.choice([1, 3, 200]) for n in r.sample(range(1, capacity + 1), min(capacity, r.choice([1, 4, 200])))}
    bins, seen = defaultdict(list), defaultdict(int)
    for length, low, high, per, sequence, offset in packing.plan(counts, capacity):
        assert seen[length] == low
        seen[length] = high
        for k in range(high - low):
            bins[sequence + k // per].append((offset + k % per * length, length))
    assert seen == counts
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("id", F.lit("clash"))
    odd = docs.limit(1).withColumn("text", F.lit(None).cast("string")).union(docs.limit(1).withColumn("text", F.lit("12 … !")))
    model = language.learn(docs.where("doc_id % 4 <> 2"), "text", "lang", F.xxhash64("doc_id"))
    got = language.predict(docs.where("doc_id % 4 = 2"), model, "doc_id", "text").join(docs.withColumnRenamed("id", "c"), F.col("id") == F.col("doc_id"))
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95
    assert {(r.lang_pred, r.score) for r in language.predict(odd, model, "doc_id", "text").collect()} == {("und", 0.0)}
    assert language.predict(docs.where("false"), model, "doc_id", "text").count() == 0
    nothing = language.learn(docs.where("false"), "text", "lang", F.xxhash64("doc_id"))
    assert language.predict(docs.limit(2), nothing, "doc_id", "text").select("lang_pred").distinct().collect()[0][0] == "und"


def test_codewords_are_apart():
    code = language.codewords(10)
    gaps = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert min(gaps) >= 4 and set(np.unique(code)) == {-1.0, 1.0}


def test_toxicity(spark):
    r = random.Random(1)
    clean = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + r.choice(["", "s", "ly"]) for _ in range(n))
    bad = [clean(100) + " nasty " + clean(r.randint(0, 200)) + " Vile! " + clean(20) for _ in range(150)]
    model = toxicity.fit(bad + [clean(150) for _ in range(300)], [1] * 150 + [0] * 300)
    frame = table(spark, [(1, clean(3000) + " nasty, " + clean(3000)), (2, clean(3000)), (3, None), (4, ""), (5, "vile")]).withColumn("score", F.lit("old"))
    got = {x.doc_id: x.score for x in toxicity.score(frame, model, "text", "score").collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] == pytest.approx(1 / 3) and got[5] > 0.5
    assert toxicity.score(empty(spark), model, "text", "score").count() == 0


@pytest.mark.parametrize("prior", [0.5, 0.9, 1.0])
def test_texts_without_words_are_never_toxic(prior):
    model = toxicity.Model()
    model.prior = prior
    assert (model.scores([None, "", " \n"]) < 0.5).all()


def test_toxicity_gradient():
    model, x = toxicity.Model(3), toxicity.Inputs(["one two three four", "five six two"])
    first, size, text = x.windows()
    y = np.array([1.0, 0.0], np.float32)
    embedded = model.embed(x)
    g = model.back(x, embedded, model.tables(embedded), first, size, y)

    def loss():
        *_, logit = model.logits(x)
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    for name, at in (("rec_f", (2, 5)), ("in_b", (3, 20)), ("attend", (4, 1)), ("focus", (2,)), ("out", (9,)), ("word", (x.word[0], 3)), ("trigram", (x.trigram[0], 2))):
        step, old = 1e-2, model.p[name][at].copy()
        model.p[name][at] = old + step
        up = loss()
        model.p[name][at] = old - step
        down = loss()
        model.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-5)


def test_mixing(spark, docs, rows):
    got = mixing.mix_sources(docs, "doc_id", "text", "source").collect()
    assert len(got) == len(rows)
    n = lambda t: len((t or "").encode().split())
    assert sorted(x.size for x in got) == sorted(n(t) for _, t in rows)
    sizes = {x.source: x.source_size for x in got}
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        unit = left / sum(weight[k] for k in free)
        over = {k for k in free if unit * weight[k] > 2 * sizes[k]}
        for k in over or free:
            target[k] = 2 * sizes[k] if over else unit * weight[k]
        left -= sum(2 * sizes[k] for k in over)
        free = free - over if over else set()
    assert all(x.target == pytest.approx(target[x.source]) and 0 <= x.taken <= 2 * x.size for x in got)
    for k in names:
        assert abs(sum(x.taken for x in got if x.source == k) - target[k]) <= 2 * max(x.size for x in got if x.source == k)
    again = mixing.mix_sources(docs.repartition(5), "doc_id", "text", "source").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(empty(spark), "doc_id", "text", "source").count() == 0


def brute_groups(rows, n, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    up[i] = up[j] = min(up[i], up[j])
    low = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        low[up[i]].append(k)
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in low.items()}
    return [(k, len(sets[i]), least[up[i]] if sets[i] else k) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("node", [1_000_000, 150])
def test_jaccard_join(spark, docs, rows, monkeypatch, node):
    """With small nodes the large-family rounds run too."""
    monkeypatch.setattr(jaccard_join, "NODE_TOKENS", node)
    r, base = random.Random(3), texts()[0].split()
    more = []
    for i in range(30):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"edit{i}"
        more.append((200 + i, " ".join(w)))
    frame, every = docs.union(table(spark, more)), rows + more
    got = jaccard_join.jaccard_join(frame, n=4, percent=85).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(key((x.id, x.n_shingles, x.component_id)) for x in got) == sorted(map(key, brute_groups(every, 4, 85)))


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_join(empty(spark)).count() == 0
    got = jaccard_join.jaccard_join(table(spark, [(1, None), (2, ""), (3, "a b")])).collect()
    assert sorted((x.id, x.component_id) for x in got) == [(1, 1), (2, 2), (3, 3)]


def test_possible_overlap_never_falls_short():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 400, r.integers(5, 200), dtype=np.uint64)) for _ in range(40)]
    sets.sort(key=len)
    tree = jaccard_join.Tree(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 30 * (len(a) + len(b) - both):
                assert jaccard_join.possible(tree, 0, np.array([i]), tree, 0, np.array([j]), 30)[0]
                assert jaccard_join.possible(tree, 1, np.array([i // 16]), tree, 1, np.array([j // 16]), 30)[0]


def brute_removed(rows, n):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    hits = {i: set() for i in order}
    for i in order:
        w = (rows[i][1] or "").encode().split()
        own = set()
        for k in range(len(w) - n + 1):
            window = tuple(w[k : k + n])
            if window in own or seen.get(window, rows[i][0]) != rows[i][0]:
                hits[i] |= set(range(k, k + n))
            own.add(window)
        for window in own:
            seen.setdefault(window, rows[i][0])
    for i in order:
        w = (rows[i][1] or "").encode().split()
        kept = b" ".join(x for k, x in enumerate(w) if k not in hits[i])
        out.append((rows[i][0], len(w), len(hits[i]), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_dedup(spark, docs, rows):
    got = recompression.substring_dedup(docs, window=20).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    found = sorted(key((x.id, x.n_words, x.n_removed, digest(x.kept_text))) for x in got)
    assert found == sorted(map(key, brute_removed(rows, 20)))
    assert recompression.substring_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("alphabet", [1, 2, 5])
def test_substring_dedup_of_repetitive_words(spark, alphabet):
    r = random.Random(alphabet)
    rows = [(i, " ".join(r.choice("abcde"[:alphabet]) for _ in range(r.choice([5, 30, 200])))) for i in range(25)]
    got = recompression.substring_dedup(table(spark, rows), window=6).collect()
    found = sorted((x.id, x.n_words, x.n_removed, hashlib.sha256((x.kept_text or "").encode()).hexdigest()) for x in got)
    assert found == sorted(brute_removed(rows, 6))


def test_anchors_of_more_symbols_than_24_bits():
    """Equal windows have equal anchors, however many symbols stand before them in the slice."""
    r = np.random.default_rng(8)
    passage = r.integers(0, 2**63, 400).astype(np.uint64)
    size = (1 << 24) - 200
    words = Words([])
    words.hash = np.concatenate((np.resize(r.integers(0, 2**63, 1000).astype(np.uint64), size), passage))
    words.at = np.array([0, len(words.hash)])
    few = Words([])
    few.hash, few.at = passage, np.array([0, len(passage)])
    first, low, high, _ = recompression.anchors(words, 2, 0)
    _, low2, high2, _ = recompression.anchors(few, 2, 0)
    assert (low[-len(low2) :] - size == low2).all() and (high[-len(high2) :] - size == high2).all()


def test_spans_of_repeated_rows_are_listed_once(spark):
    spans = spark.createDataFrame([(1, 2, 0, 3)] * 50 + [(1, 2, 9, 1)], "ord long, tid long, start int, windows int")
    assert sorted(recompression.spans_by_row(spans, "start", "windows").first()["spans"]) == [(0, 3), (9, 1)]


def test_running_leaves_out_buckets_above_the_budget(spark):
    frame = spark.createDataFrame([(0, 4), (1, 4), (2, 4), (2, 4)], "slot long, size long")
    got = mixing.running(frame, [], "slot", [F.col("size")], "size", "total", 8.0)
    assert sorted(x.total for x in got.collect()) == [4, 8]


def test_fingerprints(spark, docs, rows):
    got = fingerprints.fingerprints(docs).select("id", "text", "sketch").collect()
    by_text = defaultdict(set)
    for x in got:
        by_text[x.text].add(tuple(x.sketch))
        assert list(x.sketch) == sorted(set(x.sketch)) and bool(x.sketch) == bool((x.text or "").split())
    assert all(len(v) == 1 for v in by_text.values())
    both = spark.createDataFrame([(texts()[0], texts()[17])], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    part, like = both.select(fingerprints.containment(F.col("a"), F.col("b")), fingerprints.likeness(F.col("a"), F.col("a"))).first()
    assert part == 1.0 and like == 1.0
    assert fingerprints.fingerprints(empty(spark)).count() == 0


def test_next_rows_follow_descending_order(spark):
    ids = random.Random(1).sample(range(-(10**12), 10**12), 300)
    frame = spark.createDataFrame([(i, i % 7, str(i)) for i in ids], "ord long, tid long, text string").repartition(7)
    got = {x.ord: x.next for x in fingerprints.with_next(frame, "ord", "tid", "text", "next").collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: str(b) for a, b in zip(down, down[1:] + down[:1])}
    one = fingerprints.with_next(frame.limit(1), "ord", "tid", "text", "next").first()
    assert one.next == one.text


def low_hashes(text, n=5, scale=8):
    """All shingle hashes of a text and its sketch, in plain Python."""
    word = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    out = set()
    for i in range(max(1, len(word) - n + 1) if word else 0):
        h = 42
        for w in word[i : i + n]:
            h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), h)
        out.add(h - 2**64 if h >= 2**63 else h)
    return out, sketch_of(out, scale)


def sketch_of(hashes, scale=8):
    few = sorted(h for h in hashes if h <= 2**64 // scale - 2**63 - 1)
    return few or sorted(hashes)[:1]


def test_sketches_merge_and_estimate_as_plain_sets_do(spark):
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(["ka", "lo", "mi", "ré", "tu", "wo", "zu"]) + str(r.randrange(30)) for _ in range(n))
    pairs = []
    for _ in range(150):
        part = prose(r.randint(1, 60))
        pairs.append((part, prose(r.randint(5, 80)) + " " + part + " " + prose(r.randint(0, 40))))
        other = part.split()
        other[r.randrange(len(other))] = "changed"
        pairs.append((part, " ".join(other)))
    pairs += [("", "a b"), ("a b", ""), ("", ""), ("one two three four five", "one two three four five six")]
    frame = spark.createDataFrame(pairs, "a string, b string").select("a", "b", *[fingerprints.sketch(F.col(c)).alias(f"s{c}") for c in "ab"])
    one, two = F.col("sa"), F.col("sb")
    got = frame.select("*", fingerprints.merged(one, two).alias("m"), fingerprints.likeness(one, two).alias("like"), fingerprints.containment(one, two).alias("part"))
    told, inside = 0, 0
    for x in got.collect():
        (a, sa), (b, sb) = low_hashes(x.a), low_hashes(x.b)
        assert list(x.sa) == sa and list(x.sb) == sb
        assert list(x.m) == sketch_of(a | b)
        assert x.like == (len(set(sa) & set(sb)) / len(set(sa) | set(sb)) if sa or sb else 1.0)
        if not a:
            assert x.part == 1.0
        elif a <= b:
            inside += 1
            told += x.part is not None
            assert x.part in (None, 1.0)
        elif sa[0] > 2**61 - 2**63 - 1:
            assert x.part is None or x.part == float(sa[0] in b)
        else:
            assert x.part == len(set(sa) & b) / len(sa)
    assert inside > 120 and told > 0.7 * inside


def test_next_rows_of_one_hot_order(spark):
    """A third of all rows without id, ids that repeat and equal rows; the text of a null row counts as empty."""
    from sevspark.llm.common import ranked

    r = random.Random(3)
    ids = [None] * 100 + [7] * 40 + r.sample(range(1000), 160)
    frame = spark.createDataFrame([(i, None if k % 50 == 9 else f"text {k}", "x") for k, i in enumerate(ids)] + [(7, "text 100", "x")], "doc_id long, text string, sketch string")
    rows = ranked(frame, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).cache()
    down = sorted(rows.collect(), key=lambda x: (-x.ord, x.tid))
    wanted = sorted(zip([x.text for x in down], [x.text.upper() for x in down[1:] + down[:1]]))
    out = fingerprints.with_next(rows, "ord", "tid", "text", "next", F.upper).collect()
    assert sorted((x.text, x.next) for x in out) == sorted((a.upper(), b) for a, b in wanted)
    rows.unpersist()


def test_edited_texts_of_the_fingerprint_query(spark):
    folder = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    down = sorted(text, reverse=True)
    after = dict(zip(down, down[1:] + down[:1]))
    for r in queries.op10_fingerprints(spark, folder).collect():
        t, half = text[r.doc_id], len(text[r.doc_id]) // 2
        edited = t[: len(t) - half] + text[after[r.doc_id]][:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_folds_of_the_contract(spark):
    frame = spark.range(50).select("id", queries.fold(F.col("id"), 5).alias("fold")).collect()
    assert all(r.fold == zlib.crc32(str(r.id).encode()) % 5 for r in frame)


def test_toxicity_sample(spark):
    """Null ids, null labels and labels of no document are not learned from; rows equal in id and text count once."""
    docs = spark.createDataFrame(
        [(1, "good words here"), (2, None), (3, ""), (4, "vile bad bad"), (4, "vile bad bad"), (None, "vile")], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1), (5, None), (9, 1), (None, 1)], "doc_id long, toxic int")
    assert round(toxicity.learn(docs, labels, "doc_id", "text", "toxic").prior, 6) == round(1 / 3, 6)
    assert toxicity.learn(docs.where("false"), labels, "doc_id", "text", "toxic").prior == 0.5
