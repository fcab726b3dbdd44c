"""Duplicates: against brute force, and independent of how the rows lie."""

import random
import time

import pytest
from pyspark.sql import functions as F

from leadloom.operators import resolve
from leadloom.schema import RECORD_FIELDS, as_records


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, cb in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (ca != cb))
    return row[-1]


def names(seed, n):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 24))) for _ in range(n // 3)]
    out = list(stems)
    while len(out) < n:
        s = list(rnd.choice(stems))
        for _ in range(rnd.randint(1, 3)):
            at = rnd.randrange(len(s) + 1)
            kind = rnd.random()
            if kind < 0.4 and s:
                s[at % len(s)] = rnd.choice("abcd")
            elif kind < 0.7:
                s.insert(at, rnd.choice("abcd"))
            elif len(s) > 1:
                s.pop(at % len(s))
        out.append("".join(s))
    return sorted(set(out))


def records(spark, rows):
    fields = list(rows[0])
    return as_records(spark.createDataFrame([tuple(r.get(f, "") for f in fields) for r in rows], fields))


@pytest.mark.parametrize("hot_pairs", [resolve.HOT_PAIRS, 1])
def test_similar_names_miss_nothing(spark, hot_pairs):
    own = names(7, 150)
    nodes = spark.createDataFrame(list(enumerate(own)), "id long, name string")
    wanted = {
        (a, b) for a in own for b in own
        if (len(a), a) < (len(b), b) and a[:4] != b[:4] and distance(a, b) * 100 <= 15 * len(b)
    }
    found = resolve.similar_names(nodes, hot_pairs=hot_pairs)
    assert {(r["left_name"], r["right_name"]) for r in found.collect()} == wanted
    every = {
        (a, b) for a in own for b in own if (len(a), a) < (len(b), b) and distance(a, b) * 100 <= 15 * len(b)
    }
    found = resolve.similar_names(nodes, other_prefix_only=False, hot_pairs=hot_pairs)
    assert {(r["left_name"], r["right_name"]) for r in found.collect()} == every


def test_contained_names_miss_nothing(spark):
    own = names(3, 120)
    nodes = spark.createDataFrame(list(enumerate(own)), "id long, name string")
    wanted = {(a, b) for a in own for b in own if a != b and a in b}
    assert {(r["left_name"], r["right_name"]) for r in resolve.contained_names(nodes).collect()} == wanted


def clusters_by_hand(rows):
    def same(x, y):
        a, b = x["company_name"], y["company_name"]
        named = bool(a and b) and (
            a in b or b in a or (len(a) >= 4 and len(b) >= 4 and a[:4] == b[:4])
            or distance(a, b) * 100 <= 15 * max(len(a), len(b)))
        return bool(x["email"] and x["email"] == y["email"]) or named

    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if same(rows[i], rows[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i]["ord"]: rows[find(i)]["ord"] for i in range(len(rows))}


def test_clusters_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [
        {"ord": i, "company_name": "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 12))),
         "email": rnd.choice(["", "", f"m{rnd.randint(0, 12)}"])} for i in range(60)
    ]
    df = records(spark, rows)
    got = {r["ord"]: r["cluster"] for r in resolve.cluster_ids(df).select("ord", "cluster").collect()}
    assert got == clusters_by_hand(rows)
    again = {r["ord"]: r["cluster"] for r in resolve.cluster_ids(df.repartition(3, F.rand(1))).collect()}
    assert again == got


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    links = chain + star + [(500, 501)]
    rnd.shuffle(links)
    found = resolve.connected_components(spark.createDataFrame(links, "left_id long, right_id long"))
    got = {r["id"]: r["cluster"] for r in found.collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[501] == 500


def test_merge_order_and_info(spark):
    rows = [
        {"ord": 3, "company_name": "Acme", "email": "", "phone": "2", "additional_info": "A", "turnover": "late"},
        {"ord": 1, "company_name": "Acme", "email": "", "phone": "", "additional_info": "A", "turnover": ""},
        {"ord": 2, "company_name": "Acme", "email": "", "phone": "1", "additional_info": "B", "turnover": "x"},
    ]
    row = resolve.dedupe_exact(records(spark, rows)).first()
    assert (row["ord"], row["phone"], row["turnover"], row["additional_info"], row["n_records"]) == (1, "1", "", "A | B | A", 3)


@pytest.mark.parametrize("infos, wanted", [
    (["A", "A", "B", "A", "B"], "A | B | A | B"), (["A", "B", "A | B", "C"], "A | B | C"), (["", "A", "", "A"], "A"),
    (["A", "B", "B"], "A | B | B"),
])
def test_info_folding(spark, infos, wanted):
    rows = [{"ord": i, "company_name": "Acme", "additional_info": x} for i, x in enumerate(infos)]
    assert resolve.dedupe_exact(records(spark, rows)).first()["additional_info"] == wanted


def test_many_infos_stay_whole(spark):
    rows = [{"ord": i, "company_name": "Acme", "additional_info": f"note {i}"} for i in range(50)]
    df = records(spark, rows).withColumn("k", F.lit(1))
    notes = [f"note {i}" for i in range(50)]
    assert resolve.merge_cluster(df, ["k"]).first()["additional_info"] == " | ".join(notes)
    assert [r["additional_info"] for r in resolve.info_parts(df, ["k"]).orderBy("ord").collect()] == notes
    assert resolve.merge_cluster(df.withColumn("additional_info", F.lit("one")), ["k"]).first()["additional_info"] == "one"


def test_infos_that_hold_the_separator_fold_in_time(spark):
    def by_hand(parts):
        text = ""
        for part in parts:
            if part != text:
                text = f"{text} | {part}" if text else part
        return text

    rnd = random.Random(7)
    cases = [[f"a | b {i}" for i in range(50_000)], ["a", "b"] + ["a | b"] * 20_000 + ["c"] + ["a | b | c"] * 20_000]
    for _ in range(200):
        own = [rnd.choice("abé")]
        for _ in range(rnd.randint(0, 8)):  # now and then all that is there, something as long, or a part of it
            own.append(rnd.choice([by_hand(own), by_hand(own), by_hand(own)[::-1].strip(), own[0] + " | " + rnd.choice("ab"), rnd.choice(["a", "a | b", "b", "é | a"])]))
        cases.append(own)
    df = spark.createDataFrame([(i, own) for i, own in enumerate(cases)], "i int, own array<string>")
    began = time.time()
    got = {r["i"]: r["text"] for r in df.select("i", resolve._fold(F.col("own")).alias("text")).collect()}
    assert got == {i: by_hand(own) for i, own in enumerate(cases)}
    assert time.time() - began < 20  # 1.7 billion places were copied for the first two before


def test_empty_keys_form_one_group(spark):
    rows = [{"ord": i, "company_name": n, "address": f"a{i}"} for i, n in enumerate(["---", "", "Acme"])]
    got = resolve.dedupe_exact(records(spark, rows)).orderBy("ord").collect()
    assert [(r["ord"], r["n_records"]) for r in got] == [(0, 2), (2, 1)]


def test_dedupe_is_idempotent(spark):
    rows = [{"ord": i, "company_name": f"{w} {i % 3}", "email": ""} for i, w in enumerate(["Stone Mill", "Stone Mil", "Other", "Blue"] * 4)]
    once = resolve.dedupe(records(spark, rows))
    twice = resolve.dedupe(once.select("ord", *RECORD_FIELDS))
    key = lambda df: sorted((r["ord"], r["company_name"]) for r in df.collect())
    assert key(once) == key(twice)


def test_seed_rules(spark):
    seeds = spark.createDataFrame([
        (1, "https://www.site.in/a"), (2, "https://m.site.in/b"), (3, "https://www.indiamart.com/x"),
        (4, "https://indiamart.com/x"), (5, "https://www.indiamart.com/y"), (6, "https://team.com/"), (7, "https://teacom/"),
    ], "ord long, url string")
    assert [r["ord"] for r in resolve.dedupe_seeds(seeds).orderBy("ord").collect()] == [1, 3, 5, 6]
    assert [r["ord"] for r in resolve.dedupe_seeds(seeds, prefix_only=True).orderBy("ord").collect()] == [1, 3, 5, 6, 7]
    assert resolve.dedupe_seeds(seeds, max_results=2).count() == 2


def test_no_cross_product_in_plans(spark):
    own = spark.createDataFrame([(i, f"name{i}") for i in range(5)], "id long, name string")
    for df in (resolve.similar_names(own), resolve.star_links(own, F.col("name"), "id", "x")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_few_pieces_of_long_names(spark):
    counts = {}
    for n in (20, 60, 120):
        one = spark.createDataFrame([(1, "x" * 4 + "".join(chr(97 + i % 23) for i in range(n - 4)))], "id long, name string")
        counts[n] = resolve._pieces(one, False, 1).count()
    assert all(counts[n] <= most for n, most in ((20, 30), (60, 400), (120, 2600))), counts


def test_similar_names_of_all_lengths_miss_nothing(spark):
    rnd = random.Random(11)
    own = set()
    for size in (7, 13, 20, 27, 34, 47, 60):
        for _ in range(4):
            name = [rnd.choice("ab") for _ in range(size)]
            own.add("".join(name))
            for _ in range(8):
                near = list(name)
                for _ in range(rnd.randint(1, max(1, size * 15 // 100))):
                    at = rnd.randrange(len(near))
                    near[at:at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "ab"])
                own.add("".join(near))
    own = sorted(x for x in own if x)
    nodes = spark.createDataFrame(list(enumerate(own)), "id long, name string")
    wanted = {(a, b) for a in own for b in own if a != b and (len(a), a) < (len(b), b) and distance(a, b) * 100 <= 15 * len(b)}
    found = {tuple(sorted((r["left_name"], r["right_name"]), key=lambda x: (len(x), x)))
             for r in resolve.similar_names(nodes, other_prefix_only=False).collect()}
    assert found == wanted
