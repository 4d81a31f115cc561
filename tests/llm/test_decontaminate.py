from tidemark.llm.decontaminate import clean, leaks

ITEMS = [
    (1, "Alice has 12 apples and gives 5 apples to Bob. How many apples does Alice have after she eats 2 kg of them with her old friend Bob?"),
    (2, "the quick brown fox jumps over the lazy dog while seven small birds sing in the tall green tree near home"),
    (3, None), (4, ""), (5, "one two three"), (6, "A 1 B 2 C 3 D 4 E 5 F"),
    (7, "when Ann saw Bob and then Ann told Bob that both Ann and Bob were at the same old place as Ann"),
]
DOCS = [
    (10, "intro words here. " + ITEMS[0][1] + " and the end of it"),
    (11, "So Carol has 30 apples and gives 9 apples to Dave. How many apples does Carol have after she eats 4 lb of them with her old friend Dave? Yes."),
    (12, "when Carl saw Dan and then Eve told Fay that both Gus and Hal were at the same old place as Ida"),
    (20, "when Carl saw Dan and then Carl told Dan that both Carl and Dan were at the same old place as Carl"),
    (13, "something else entirely about the lazy dog and the quick brown fox that has nothing in common with it"),
    (14, "THE END. " + ITEMS[1][1].replace("lazy", "sleepy") + "\nmore"),
    (15, None), (16, ""), (17, "A 9 B 8 C 7 D 6 E 5 G"), (18, "one two three"), (19, ITEMS[1][1] + " " + ITEMS[0][1]),
]


def frames(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, h int"), spark.createDataFrame(items, "item_id long, text string")


def test_leaks(spark):
    docs, items = frames(spark)
    got = {(r.doc_id, r.item_id): r for r in leaks(docs, items).collect()}
    assert set(got) == {(10, 1), (11, 1), (14, 2), (18, 5), (19, 1), (19, 2), (20, 7)}
    assert got[10, 1].covered == 1 and got[11, 1].slots > 3
    assert sorted(r.doc_id for r in clean(docs, items).collect()) == [12, 13, 15, 16, 17]
    assert clean(docs, items).columns == docs.columns


def test_every_planted_passage_is_found(spark):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()}
    flat = lambda t: " ".join((t or "").split())
    planted = {(x.doc_id, y.item_id) for y in items.collect() for x in docs.collect() if flat(y.text) in flat(x.text)}
    assert planted and planted <= got
    assert len(got) <= len(planted) + 5


def test_odd(spark, odd, empty, repeated):
    _, items = frames(spark)
    for docs in (odd, empty):
        assert leaks(docs, items).collect() == []
    assert leaks(odd, items.limit(0)).collect() == []
    assert sorted(r.doc_id or 0 for r in leaks(repeated, spark.createDataFrame([(7, "a b")], "item_id long, text string")).collect()) == [0, 1, 1, 2]


def test_an_occurrence_beside_other_versions_is_found(spark):
    """Other versions of the same template in the document don't hide a copy, nor one with a word put in."""
    pays = "if Ann pays 3 dollars and Ben pays 8 dollars while Cid pays 4 dollars and Dee pays 9 dollars then how many dollars did they all pay"
    other = "if Eve pays 5 dollars and Fay pays 2 dollars while Gus pays 7 dollars and Hal pays 6 dollars then how many dollars did they all pay"
    line = "when Carl saw Dan and then Eve told Fay that both Gus and Hal were at the same old place as Ida"
    put_in = pays.replace("then how", "then just how")
    docs = [(1, pays), (2, f"{pays}\n{other}"), (3, ITEMS[6][1] + "\n" + "\n".join([line] * 4)), (4, line), (5, f"{other}\n{put_in}\n{other}")]
    docs, items = frames(spark, docs, [(7, ITEMS[6][1]), (8, pays)])
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} == {(1, 8), (2, 8), (3, 7), (5, 8)}


def test_copies_without_a_template_are_found(spark):
    """Title case, upper case, many numbers, and short items inside longer documents."""
    title = "The Old Man Of The Green Hill And His Two Very Small Grey Dogs"
    sums = "Compute 12 + 34 + 56 + 78 + 90 and then divide the result by 7"
    docs = [(1, f"so {title} it is"), (2, ITEMS[1][1].upper()), (3, f"Now: {sums}. Well"), (4, "well there are one two three of them"), (5, "one two four three"), (6, ITEMS[5][1] + " then")]
    docs, items = frames(spark, docs, [ITEMS[1], ITEMS[4], ITEMS[5], (8, title), (9, sums)])
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} == {(1, 8), (2, 2), (3, 9), (4, 5), (6, 6)}


def test_clean_tells_rows_with_null_and_repeated_ids_apart(spark):
    docs, items = frames(spark, [(None, ITEMS[1][1]), (1, "see " + ITEMS[1][1]), (1, "clean row"), (None, "another clean row"), (2, "and one more")], [ITEMS[1]])
    assert sorted(r.text for r in clean(docs, items).collect()) == ["and one more", "another clean row", "clean row"]
