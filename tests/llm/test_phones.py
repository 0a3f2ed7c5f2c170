from pyspark.sql import functions as F

from certloom.llm import pii


def test_phones_with_any_area_after_the_country_code(spark):
    texts = ["+1 (032) 555-8455", "+1 (132) 055-8455", "+1 832 155-0001", "+1 (832) 555-8455", "(832) 555-8455", "(032) 555-8455"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.digest(docs, "k").collect()}
    assert [got[i]["n_phone"] for i in range(6)] == [1, 1, 1, 1, 1, 0]
    assert all(got[i]["text"] != t and len(got[i]["text"]) == len(t) for i, t in enumerate(texts[:5])) and got[5]["text"] == texts[5]
    assert got[3]["text"] == f"+1 {got[4]['text']}" and got[0]["text"][4] in "01" and got[1]["text"][9] in "01"
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("+1 (0"), F.lpad((F.col("id") % 100).cast("string"), 2, "0"), F.lit(") 5"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("t"))
    many = many.select("doc_id", F.concat(F.substring("t", 1, 12), F.lit("-"), F.substring("t", 13, 4)).alias("text"))
    assert pii.digest(many, "k").where("n_phone = 1").select("text").distinct().count() == many.select("text").distinct().count() == 3000
