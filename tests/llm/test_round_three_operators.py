"""MinHash near duplicates, conversation tries and the filter audit against brute force, with odd rows and shapes."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from sevspark.llm import filter_audit, minhash, prefix_trie, queries  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, label string, bands string"
TURNS = "conv_id long, turn long, role string, text string, code string, path string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, "k", "l", "b") for i, t, lang in rows], DOCS)


# --- near duplicates


def shingles(text, n=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, min(len(words), 1)))}


def linked(rows, percent, n=5):
    """Components by comparing all pairs: the group's number of each row."""
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def of(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[of(i)] = of(j)
    return [of(i) for i in range(len(rows))], sets


def near_rows():
    r = random.Random(3)
    prose = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows, chain = [], prose(120)
    for _ in range(25):  # each links with the one before, not with the first
        chain = list(chain)
        chain[r.randrange(120)] = f"c{len(rows)}"
        rows.append(" ".join(chain))
    base = prose(100)
    for i in range(90):  # similarities on both sides of the limit
        copy = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6])):
            copy[r.randrange(100)] = f"x{i}"
        rows.append(" ".join(copy))
    passage = prose(60)
    rows += [" ".join(prose(150) + passage + prose(150)) for _ in range(20)]
    rows += ["A b c d e", "a B c d e", "a b c", "a  b\tc", "a b", "", None, " \n", "z " * 3000, "z " * 2999, " ".join(prose(20_000)), " ".join(base)]
    return [(i * 13 % 1009, t) for i, t in enumerate(rows)] + [(None, " ".join(prose(30)))] * 2 + [(None, "alone here"), (4, "unlike four"), (4, rows[3])]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = near_rows()
    group, sets = linked(rows, percent)
    docs = docs_of(spark, [(*x, "en") for x in rows]).repartition(5)
    got = minhash.near_duplicates(docs, percent=percent).collect()
    assert len(got) == len(rows)
    have = {}
    for x in got:
        have.setdefault((x.id, x.n_shingles), []).append(x)
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(least.get(g, 2**63), 2**63 - 1 if i is None else i)
    want = sorted((str(i), len(s), str(None if least[g] == 2**63 - 1 else least[g])) for (i, _), g, s in zip(rows, group, sets))
    assert sorted((str(x.id), x.n_shingles, str(x.component_id)) for x in got) == want
    assert all(x.kept == (x.id == x.component_id) for x in got if x.id is not None)
    assert all(x.group_key is None for x in got if not x.n_shingles)
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_signatures_estimate_similarity_with_two_permutations():
    r = np.random.default_rng(1)
    token = r.integers(0, 2**63, 300, dtype=np.uint64)
    x, y = np.sort(token[:200]), np.sort(token[100:])
    sig = minhash.signatures(np.concatenate((x, y)), np.array([0, 200, 400]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.05
    # a shifted permutation, not another hash: coordinate k of a set is coordinate 0 of the set moved back by k
    one = minhash.signatures(token[:1], np.array([0, 1]), 4)
    assert len(set(one[0].tolist())) == 4


def test_bands_find_pairs_at_the_limit():
    """Recall of the bands alone over pairs of sets at a similarity of 0.85."""
    r = np.random.default_rng(2)
    missed = 0
    for _ in range(300):
        token = r.integers(0, 2**63, 107, dtype=np.uint64)
        both = np.concatenate((token[:100], token[7:107]))  # 93 of 107
        values = minhash.band_values(minhash.signatures(both, np.array([0, 100, 200]), minhash.BANDS * minhash.ROWS), minhash.ROWS)
        missed += not (values[0] == values[1]).any()
    assert missed == 0


# --- conversation tries


def brute_trie(rows, rebuilt):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(t)] for c, t in own.items()}
    if rebuilt:
        head = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        base = {c: c - int(np.fmod(c, 20)) for c in own}
        own = {c: own.get(base[c], [])[: head[c]] + t[head[c] :] for c, t in own.items()}
    nodes = {}
    for c, t in own.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append((c, d == len(t)))
    out = {p: [min(c for c, _ in m), len(p), None, len(m), 0, 0, 0, hashlib.sha256(",".join(str(c) for c, e in sorted(m) if e).encode()).hexdigest()] for p, m in nodes.items()}
    for p in nodes:
        if p:
            out[p][2] = out[p[:-1]][0]
            out[p[:-1]][4] += 1
    for p, x in out.items():
        gain = (x[3] - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            out[p[:d]][5] += x[4] == 0
            out[p[:d]][6] += gain
    return sorted((tuple(x) for x in out.values()), key=repr)


def conversation_rows():
    r = random.Random(8)
    rows = []
    for c in [*range(-30, 90), 4000, 4001]:
        if c % 20 == 0 and c % 40:
            continue  # a base that is absent
        texts = ["hello"] + [r.choice(["a b", "c  d\te", "", "ü"]) for _ in range(r.randrange(0, 25))]
        rows += [(c, t, r.choice(["user", "bot"]) if t else "user", x) for t, x in enumerate(texts)]
    rows += [(50, None, None, None), (51, None, "user", "first"), (52, 3, "x", "tie"), (52, 3, "x", "tie"), (52, 3, "w", "tie"), (None, 1, "user", "no conversation")]
    rows += [(c, t, "user", f"same {t}") for c in range(500, 560) for t in range(20)]
    rows += [(77, t, "user", "long chain " + "w " * 500) for t in range(100, 400)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuilt", [True, False])
def test_trie(spark, rebuilt, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", 100)
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 150)
    rows = conversation_rows()
    turns = spark.createDataFrame([(*x, "c", "p") for x in rows], TURNS).repartition(4)
    rebuild = (lambda p: prefix_trie.shared_heads(p, F.expr("conv_id - conv_id % 20"), queries.fold(F.col("conv_id"), 4), 3)) if rebuilt else None
    got = sorted((tuple(x) for x in prefix_trie.prefix_trie(turns, rebuild).collect()), key=repr)
    assert got == brute_trie(rows, rebuilt)
    assert prefix_trie.prefix_trie(turns.where("false"), rebuild).count() == 0


def test_medians_cover_all_and_balance_the_tree():
    assert sorted(prefix_trie.medians(100)) == list(range(100)) and list(prefix_trie.medians(0)) == []
    tree = prefix_trie.Ternary()
    for i in prefix_trie.medians(1023):
        tree.insert([i], [1], i, 1, "")
    height, level = 0, [tree.down[0]]
    while level:
        height, level = height + 1, [x for at in level for x in (tree.less[at], tree.more[at]) if x]
    assert height == 10 and tree.members[0] == 1023


# --- filter audit


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, lang in rows:
        text, at = text or "", 2**63 - 1 if i is None else i
        words = WORD.findall(text)
        twin = any((2**63 - 1 if j is None else j) < at and (t or "") == text for j, t, _ in rows)
        fails = [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            bool(set(text) & set("#$%&*|")), twin,
        ]
        docs.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {p for p, *_ in docs}:
        mine = [x for x in docs if x[0] == part]
        shares = dict.fromkeys(range(5), 0)
        lines = []
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shares[f] += len(gone)
                lines.append((
                    f, part, "".join("ABCDE"[j] for j in order), step, len(left), len(gone), sum(x[1][f] for x in mine) - len(gone),
                    sum(x[1][f] and sum(x[1]) == 1 for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone),
                ))
        out += [(*line[1:], shares[line[0]]) for line in lines]
    return sorted(out)


def test_filter_audit(spark):
    r = random.Random(6)
    make = lambda n, k, extra="": " ".join(f"w{r.randrange(k)}" for _ in range(n)) + extra
    texts = [make(250, 10**6), make(250, 30), make(50, 10**6), make(300, 10**6, " #"), make(220, 10**6, " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3), "", None, "\n\t", "ÄÖ é", "X" * 50_000]
    rows = [(i % 60, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(150)]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (None, "only without id " * 80, "en"), (7, texts[3], "fr"), (7, texts[3], "fr")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 50)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    marks = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")
    docs = docs_of(spark, rows).repartition(4)
    got = filter_audit.filter_audit(docs, marks).collect()
    assert sorted(tuple(x) for x in got) == brute_audit(rows, labels)
    assert filter_audit.filter_audit(docs.where("false"), marks).count() == 0
    assert filter_audit.filter_audit(docs, marks.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_shapley_values_are_exact():
    r = random.Random(1)
    for k in (1, 2, 3, 5):
        value = [0] + [r.randrange(10**12) for _ in range(2**k - 1)]
        orders = list(permutations(range(k)))
        want = [Fraction(0)] * k
        for order in orders:
            before = 0
            for i in order:
                want[i] += Fraction(value[before | 1 << i] - value[before], len(orders))
                before |= 1 << i
        assert filter_audit.shapley(value) == want
