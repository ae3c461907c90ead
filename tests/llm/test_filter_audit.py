import collections
import itertools
import random
import re

from pyspark.sql import functions as F

from beamloom.llm import filter_audit as fa


def plain_fails(rows):
    """The letters each row of rows(doc_id, source, text) fails, by the text's definition."""
    smallest = {}
    for i, _, t in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    out = []
    for i, _, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        checks = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                  "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        out.append({k for k, v in checks.items() if v})
    return out


def brute(rows, marks):
    """Each order played through document by document."""
    fails = plain_fails(rows)
    label = lambda i, k: any(m[0] == i and m[k] == 1 for m in marks)
    flags = [(i is not None and label(i, 1), i is not None and label(i, 2)) for i, _, _ in rows]
    out, taken = {}, collections.Counter()
    parts = sorted({s or "" for _, s, _ in rows})
    for part in parts:
        mine = [k for k, r in enumerate(rows) if (r[1] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [k for k in left if letter in fails[k]]
                before = [k for k in mine if k not in left]
                left = [k for k in left if letter not in fails[k]]
                taken[part, letter] += len(gone)
                out[part, order, step] = (len(left), len(gone), sum(letter in fails[k] for k in before), sum(fails[k] == {letter} for k in mine),
                                          sum(flags[k][0] for k in gone), sum(flags[k][1] for k in gone))
    return {(part, order, step): (*v, taken[part, order[step - 1]]) for (part, order, step), v in out.items()}


def made(seed, count):
    rng = random.Random(seed)
    texts = ["", None, "a b", "A B C", "x" * 300_000, "word " * 60, " ".join(f"w{i}" for i in range(70)), "Ab# " * 55, " ".join(f"w{i} $" for i in range(60)), "é\u2003ö " * 30, "SHOUT " * 3]
    rows = [(rng.randrange(count // 2) if rng.random() < 0.9 else None, rng.choice(["a", "b", None, "", "c"]), rng.choice(texts) if rng.random() < 0.8 else " ".join(rng.choice("abcXY$") * 3 for _ in range(rng.randrange(90)))) for _ in range(count)]
    return [*rows, rows[0], rows[0], (10**6, "only", "x")]


def test_against_brute_force(spark):
    rows = made(1, 160)
    marks = [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 80)] + [(3, None, 1), (4, 1, None), (None, 1, 1), (4, 0, 0)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, text string, part int, mask int, digest int").repartition(5)
    labels = spark.createDataFrame([(*m, 9) for m in marks], "doc_id long, quality int, toxic int, part int").repartition(2)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in fa.audit(docs, labels).collect()}
    assert got == brute(rows, marks)
    assert fa.audit(docs.limit(0), labels).collect() == []
    unlabelled = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in fa.audit(docs, labels.limit(0)).collect()}
    assert unlabelled == {k: (*v[:4], 0, 0, v[6]) for k, v in got.items()}


def test_sums_are_inverted_exactly(spark):
    """The signed sums are those of the masks counted plainly, and the cells those masks."""
    rows = made(2, 120)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    masks = [sum(1 << "ABCDE".index(x) for x in f) for f in plain_fails(rows)]
    keys = [(s or "", i == 1, False) for i, s, _ in rows]
    sums = fa.parity_sums(docs, labels)
    want = {key: [sum((-1) ** bin(m & w).count("1") for m, k in zip(masks, keys) if k == key) for w in range(32)] for key in set(keys)}
    assert {(r.part, r.good, r.toxic): r.sums for r in sums.collect()} == want
    cells = {(r.part, r.good, r.toxic, r["mask"]): r.documents for r in fa.cells(sums).filter("documents <> 0").collect()}
    assert cells == collections.Counter((*k, m) for k, m in zip(keys, masks))


def test_other_filters(spark):
    """Any number of conditions; here two and the repeated texts."""
    docs = spark.createDataFrame([(1, "s", "x"), (2, "s", "x"), (3, "s", "long text"), (4, "s", "y")], "doc_id long, source string, text string")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    filters = {"S": lambda text, words, distinct: words < 2, "X": lambda text, words, distinct: F.contains(text, F.lit("x"))}
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.good_lost, r.shapley) for r in fa.audit(docs, labels, filters).collect()}
    assert len(got) == 18 and got["SXE", 1] == (1, 3, 1, 3 + 2 + 6) and got["XES", 3] == (0, 1, 0, 11) and got["EXS", 1] == (3, 1, 1, 2)
