from pyspark.sql import functions as F

from sightline.functions.text import normalize_text
from sightline.functions.wording import attributed_quotations
from sightline.sources.stage import dealt


def test_rows_hashed_by_the_key_are_dealt_all_the_same(spark):
    rows = spark.range(400).select((F.col("id") % 200).cast("string").alias("page")).distinct()
    tasks = dealt(rows, "page").select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bare_letters_of_any_text(spark):
    cases = {"Plain  ASCII\ttext": "plain ascii text", "École  d’été": "ecole d’ete", "é A": "e a", "": "", "中 a": "中 a"}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", normalize_text(F.col("v")).alias("x")).collect()
    assert {r.v: r.x for r in rows} == cases
    assert spark.createDataFrame([(None,)], "v string").select(normalize_text(F.col("v")).alias("x")).first().x is None


def test_quotations_are_sought_in_quoted_texts_only(spark):
    said = 'x' * 200 + ' according to ann lee "this is a quotation of fitting length" and more'
    texts = [(0, said), (1, "no mark at all. " * 30), (2, said * 3), (3, "")]
    rows = spark.createDataFrame(texts, "i int, v string").select("i", attributed_quotations(F.col("v")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {0: 1, 1: 0, 2: 3, 3: 0}
