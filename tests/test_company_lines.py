"""ER6: the best line of the company, found from the highest scores down."""

from pyspark.sql import functions as F

from transitframe.operators import resolve


def test_best_line_of_each_company_against_brute_force(spark, monkeypatch):
    parts = ["CENTRO", "PRAIA", "NORTE", "SUL", "FAROL", "POÇO", "JATIUCA", "VERGEL"]
    word = lambda i, k: parts[(i * k + i // 3) % 8]
    active = [(f"E{i % 2}", f"{i:04d}", f"{i % 7:04d} {word(i, 3)} {word(i, 5)}", i) for i in range(40)]
    listed = [(i, f"E{i % 3}", f"{i % 9:04d} {word(i, 7)}", f"IDA {word(i, 3)} {word(i, 2)}", "" if i % 2 else active[i][2].lower()) for i in range(40)]
    words = lambda s: {w for w in s.upper().replace("Ç", "C").split() if len(w) >= 3}
    want = {}
    for number, company, *names in listed:
        found = []
        for owner, code, name, order in active:
            for mine in (words(n) for n in names if n):
                score = len(mine & words(name)) / len(mine | words(name))
                if owner == company and score >= 0.25:
                    found.append((-score, order, code))
        want[number] = (min(found)[2], -min(found)[0]) if found else (None, None)
    compared = []
    plain = resolve.jaccard_join
    monkeypatch.setattr(resolve, "jaccard_join", lambda left, *a, **b: compared.append(left.count()) or plain(left, *a, **b))
    got = resolve.match_company_lines(
        spark.createDataFrame(listed, "listing_id int, company string, line string, name_ida string, name_volta string"),
        spark.createDataFrame(active, "company string, code string, name string, ord int"),
    )
    assert {r.listing_id: (r.code, r.score) for r in got.collect()} == want
    assert len({s for _, s in want.values()}) > 3
    # listings with an equal line never reach the comparison
    equal = sum(s == 1.0 for _, s in want.values())
    assert equal > 0 and max(compared) <= 2 * len(listed) + sum(1 for x in listed if x[4]) - 2 * equal


def test_listings_with_an_equal_line_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(resolve, "jaccard_join", None)
    lines = spark.range(300).select(
        F.lit("E").alias("company"), F.concat(F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(" CENTRO PRAIA")).alias("name"), "id"
    )
    active = lines.select("company", F.col("id").cast("string").alias("code"), "name", F.col("id").alias("ord"))
    listed = lines.select(F.col("id").alias("listing_id"), "company", F.lower("name").alias("line"), F.lit("").alias("name_ida"), F.lit("").alias("name_volta"))
    got = resolve.match_company_lines(listed, active).collect()
    assert len(got) == 300 and all(r.code == str(r.listing_id) and r.score == 1.0 for r in got)
