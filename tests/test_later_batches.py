"""Queries over the batches of recalled documents take every later batch."""

from corpusloom.plans import catalogue as C


def test_prompts_of_all_later_batches(spark, tmp_path):
    schema = "doc_id string, url string, title string, content string, distance double, batch int"
    old = [("s", "https://e.test/s", "S", "stored text", 0.25, 0)]
    late = [(f"d{b}", f"https://{'e' if b % 2 else 'f'}.test/{b}", f"D{b}", f"text {b}", None, b) for b in (1, 2, 5, 6, 7)]
    spark.createDataFrame(old + late + [("n", "https://e.test/n", "N", None, None, 3)], schema).write.parquet(f"{tmp_path}/similar_document.parquet")
    got = {r.doc_id: r.prompt for r in C.QUERIES["decide_prompt"](spark, str(tmp_path)).collect()}
    assert sorted(got) == ["d1", "d2", "d5", "d6", "d7"]
    assert all(("stored text" in p) == (k in ("d1", "d5", "d7")) for k, p in got.items())
