"""Operators 5 and 7, and the components they rest on."""

import collections
import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from lagfield.llm import components, exact_dedup, queries, simhash
from tools.compare import compare, duck
from text_fixtures import awkward, empty, rows


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected_copies(all_rows):
    groups = collections.defaultdict(list)
    for i, t, *_ in all_rows:
        groups[normal(t)].append(i)
    return groups


def check_exact(found, all_rows):
    groups = expected_copies(all_rows)
    assert len(found) == len(all_rows)
    kept = collections.Counter()
    for r in found:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.sha)
        ids = groups[text]
        assert r.record.id in ids and r.copies == len(ids)
        assert r["first"].id == min((i for i in ids if i is not None), default=None)
        kept[text] += r.kept
    assert set(kept.values()) == {1}


def test_exact_copies_of_awkward_rows(spark):
    found = exact_dedup.find_copies(awkward(spark))[0]
    check_exact(found.select("*", exact_dedup.stays().alias("kept"), F.col("digest").alias("sha")).collect(), rows())
    assert exact_dedup.find_copies(empty(spark))[0].count() == 0


def test_kept_rows_have_all_columns(spark):
    docs = awkward(spark)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(expected_copies(rows()))
    assert exact_dedup.keep_first(empty(spark)).count() == 0


def test_colliding_digests_are_told_apart_by_their_bytes(spark):
    weak = lambda body: (F.length(body) % 2).cast("string")
    docs = awkward(spark)
    found, placed, file, row = exact_dedup.find_copies(docs, digest=weak)
    sha = placed.select(
        F.col(file).alias("f"), F.col(row).alias("r"), F.sha2(exact_dedup.normal(F.col("text")), 256).alias("sha")
    )
    joined = found.join(sha, (F.col("record.file") == F.col("f")) & (F.col("record.row") == F.col("r")))
    check_exact(joined.select("record", "first", "copies", "sha", exact_dedup.stays().alias("kept")).collect(), rows())


def test_state_outlives_a_run(spark, tmp_path):
    log, state = str(tmp_path / "log"), str(tmp_path / "state")

    def arrive(ids):
        df = spark.createDataFrame([(str(i % 3), i) for i in ids], "digest string, id long")
        df = df.select("digest", F.struct("id").alias("record"))
        df.write.mode("append").parquet(log)
        return {r.digest: (r["first"].id, r.copies) for r in exact_dedup.absorb(spark, log, df.schema, state).collect()}

    assert arrive([5, 6, 8]) == {"0": (6, 1), "2": (5, 2)}
    assert arrive([0, 1, 2, 3]) == {"0": (0, 3), "1": (1, 1), "2": (2, 3)}


def test_one_state_serves_many_tables(spark, tmp_path):
    """Three arrivals; a collision between the first and the third, an equal text in all, a smaller id last."""
    weak = lambda body: F.substring(body, 1, 1)
    state, seen = str(tmp_path / "kept"), []
    arrivals = [
        [(10, "apple"), (11, "berry one"), (12, None), (11, "berry one")],
        [(20, "cherry"), (21, "berry  one"), (22, " ")],
        [(30, "avocado"), (5, "berry\tone"), (32, "apple"), (33, "cherry"), (34, "avocado"), (35, "")],
        [(40, "avocado"), (41, "apple"), (42, "date")],
    ]
    for k, own in enumerate(arrivals):
        path = str(tmp_path / f"table{k}")
        spark.createDataFrame(own, "doc_id long, text string").repartition(2).write.parquet(path)
        seen += own
        groups = collections.defaultdict(list)
        for i, t in seen:
            groups[normal(t)].append(i)
        want = collections.Counter((i, min(groups[normal(t)]), len(groups[normal(t)])) for i, t in own)
        found = exact_dedup.find_copies(spark.read.parquet(path), digest=weak, state=state)[0]
        assert collections.Counter((r.record.id, r["first"].id, r.copies) for r in found.collect()) == want
    nothing = exact_dedup.find_copies(spark.read.parquet(path).where("false"), digest=weak, state=state)[0]
    assert nothing.count() == 0


def test_sql_agrees(spark, sf_dir):
    name = "op5_exact_dedup"
    problem, n = compare(spark, duck(sf_dir), name, queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir)
    assert problem is None and n > 0
    assert entry_points.oracle_sql()[name] == queries.ORACLE_SQL[name]


def naive_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(prints):
    """prints: fingerprint of each node; root of each node by comparing all pairs."""
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(prints))]


def check_near(found, all_rows):
    prints = [naive_fingerprint(t) for _, t, *_ in all_rows]
    roots = naive_components(prints)
    least = collections.defaultdict(list)
    for (i, *_), r in zip(all_rows, roots):
        least[r].append(i)
    want = collections.Counter(
        (i, p, min((x for x in least[r] if x is not None), default=None)) for (i, *_), p, r in zip(all_rows, prints, roots)
    )
    assert collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == want


def test_near_copies_of_awkward_rows(spark):
    check_near(simhash.near_duplicates(awkward(spark)).collect(), rows())
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_near_copies_of_the_small_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_near(simhash.near_duplicates(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_one_row_of_each_component_stays(spark):
    docs = awkward(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(naive_components([naive_fingerprint(t) for _, t, *_ in rows()])))
    assert simhash.one_of_each(empty(spark)).count() == 0


def test_crowded_keys_lose_no_link(spark):
    draw = random.Random(3)
    centre = draw.getrandbits(64)
    prints = {centre, draw.getrandbits(64)}
    while len(prints) < 400:  # chains of close fingerprints, many on one key
        near = draw.choice(sorted(prints))
        prints.add(near ^ 1 << draw.randrange(20) ^ 1 << draw.randrange(64))
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    for crowd in (4, 64, 10**6):
        links = simhash.close_links(fps, crowd=crowd)
        root = {r.node: r.root for r in components.components(links).collect()}
        got = [root.get(p, p) for p in signed]
        want = naive_components(prints)
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_components_of_a_chain_a_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1300)]
    links = spark.createDataFrame(chain + star + [(5, 5), (1, 2), (2, 1)], "a long, b long")
    root = {r.node: r.root for r in components.components(links).collect()}
    assert components._with_least(links)[0].where("m > b").count() == 0
    assert root == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(1000, 1300)]} | {1: 1, 2: 1}
    assert components.components(links.where("a < 0")).count() == 0
