import datetime
import random
import re
import unicodedata

from chronolens.plans import group_queries


def test_prompts_hold_whole_texts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(c, t, "user", " ".join(rng.choice(("a|b", "e\u0301", "word\t", "long")) for _ in range(rng.randrange(1, 400)))) for c in range(5) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r["prompt"] for r in group_queries.prompt_render(spark, str(tmp_path)).collect()}
    for c in range(5):
        lines = [f"{t} | user | " + re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).strip().replace("|", "/") for own, t, _, text in rows if own == c]
        assert got[c] == "\n".join(lines)


def test_orders_of_every_year_get_a_class(spark, tmp_path):
    days = [datetime.date(y, m, 7) for y, m in ((1995, 3), (1996, 3), (1997, 3), (1998, 3), (1998, 9), (1999, 9))]
    rows = [(9 * k + 11, 1, "F", d) for k, d in enumerate(days)] + [(9 * k + 2009, 2, "F", datetime.date(1995 + k, k + 1, 9)) for k in range(4)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["accession_no"]: r["class"] for r in group_queries.pair_class(spark, str(tmp_path)).collect()}
    assert [got[k] for k, *_ in rows] == ["unclassified"] * 3 + ["routine"] * 3 + ["unclassified"] * 3 + ["opportunistic"]
    assert group_queries.event_class(spark, str(tmp_path)).count() == 10
