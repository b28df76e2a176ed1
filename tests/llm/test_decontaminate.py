from sightline.llm import catalog, decontaminate

ITEMS = "item_id long, text string, doc_id long, hash int"
TEMPLATE = "{a} has {n} apples and gives {m} of them to {b} . How many apples does {a} still have after that ?"


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 9, 9) for i, t in rows], ITEMS)


def pairs(df):
    return sorted((r["doc_id"], r["item_id"]) for r in df.collect())


def test_other_numbers_and_names_are_found_if_consistent(spark, docs_of):
    item = "Once " + TEMPLATE.format(a="Anna", b="Bert", n="12", m="5")
    docs = docs_of(
        [
            (1, "Before it. Once " + TEMPLATE.format(a="Carla", b="Dora", n="700", m="31") + " And more follows."),
            (2, "Once " + TEMPLATE.format(a="Anna", b="Bert", n="12", m="5")),
            (3, "Once Carla has 700 apples and gives 31 of them to Dora . How many apples does Emil still have after that ?"),
            (4, "Nothing of the kind is written in this text, which talks about other things entirely."),
            (5, None),
            (6, ""),
        ]
    )
    assert pairs(decontaminate.contaminated(docs, items_of(spark, [(7, item), (8, None), (9, "")]))) == [(1, 7), (2, 7)]


def test_equal_slots_must_be_filled_equally(spark, docs_of):
    items = items_of(spark, [(1, "we add 3 and 3 to get the sum of both of them now")])
    docs = docs_of([(1, "we add 4 and 4 to get the sum of both of them now"), (2, "we add 4 and 5 to get the sum of both of them now")])
    assert pairs(decontaminate.contaminated(docs, items, size=6)) == [(1, 1)]


def test_verbatim_words_count_beside_an_inconsistent_slot(spark, docs_of):
    item = (
        "we put 12 red stones into the first box and then walk along the river until the old bridge , "
        "where 12 more stones and 40 small shells are waiting for us under a green cloth"
    )
    docs = docs_of(
        [
            (1, item),
            (2, "Before it. " + item.replace("12 more", "13 more")),  # equal numbers become different
            (3, "Before it. " + item.replace("40 small", "12 small")),  # different ones become equal
            (4, "we put 7 red stones into the first box and more"),  # one window, not verbatim
            (5, item.replace("12", "7", 1).replace("40", "9")),  # verbatim from the red stones to the small shells
        ]
    )
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs, items_of(spark, [(1, item)])).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert got[1]["cover"] == 1 and got[2]["run"] >= 13 and got[3]["run"] >= 13 and got[5]["run"] >= 13
    assert got[2]["doc_at"] == 2 and got[5]["doc_at"] == 3
    short = "we add 12 plums to the bowl and see that 12 of them are still green and hard as wood"
    found = decontaminate.contaminated(docs_of([(1, short.replace("12 of", "13 of"))]), items_of(spark, [(1, short)])).collect()
    assert [(r["cover"], r["run"]) for r in found] == [(0.95, 10)]  # 19 of 20 words


def test_short_items_blocks_and_repeats(spark, docs_of):
    items = items_of(spark, [(1, "small question here"), (2, "small question here"), (3, "Another quite long question that nobody asks in any of the texts")])
    docs = docs_of([(1, "a small question here ."), (1, "a small question here ."), (2, "long " * 60_000 + "small question here"), (3, "here question small")])
    want = [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert pairs(decontaminate.contaminated(docs, items)) == want
    assert pairs(decontaminate.contaminated(docs, items, block_windows=2)) == want
    assert decontaminate.contaminated(docs_of([]), items).count() == 0
    assert decontaminate.contaminated(docs, items_of(spark, [])).count() == 0


def test_query_finds_every_copied_item(spark):
    sf = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"])
    assert pairs(catalog.QUERIES["op8_benchmark_decontamination"](spark, sf)) == want
