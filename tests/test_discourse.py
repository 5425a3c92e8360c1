from quillspark.operators import discourse as dc

INTRO = "Many people read this book. I argue that fear shapes the island."
BODY = 'Fear drives the boys. "They said it was a beast of the water," Jack cries. This shows that fear grows. On the other hand, hope stays. Although it fades, it returns.'
END = "In the end fear wins. Ultimately it is about society."


def test_moves_of_a_small_essay(spark):
    df = spark.createDataFrame([(1, "\n".join([INTRO, BODY, END]))], "id int, text string")
    r = dc.moves(dc.documented(df)).first()
    assert [s.move for s in r._moves] == ["context", "thesis", "claim", "evidence", "explanation", "counterpoint", "qualification", "conclusion", "implication"]
    assert [p.role for p in r._flow] == ["introduction", "body", "conclusion"] and r._flow[1].distinct == 5
    assert r._chains == [["interpretation", "qualification"]]


def test_features(spark):
    df = spark.createDataFrame([(1, "\n".join([INTRO, BODY, END])), (2, ""), (3, None)], "id int, text string")
    rows = {r.id: r for r in dc.of_texts(df).collect()}
    a = rows[1]
    assert a.chainLength == 3 and a.counterPerParagraph == 1 / 3 and a.evidencePerClaim == 0.5 and a.summaryShare == 0
    assert abs(a.quotesPer100 - 100 / a._n) < 1e-9 and a.meanQuoteLength is None and a.concreteShare + a.abstractShare <= 100
    assert rows[2].abstractionIndex is None and rows[2].evidenceTypeDiversity == 0 == rows[3].evidenceTypeDiversity


def test_chain_stops_and_strategy(spark):
    text = "Start here now. We go.\nClaim one stands. For example the beast (p. 4). For example it (12). The imagery is dark. It means a lot today.\nClose it. This is about humanity."
    df = spark.createDataFrame([(1, text.replace("For example", "Now for example"))], "id int, text string")
    r = dc.moves(dc.documented(df)).selectExpr("*").withColumn("typical", dc.typical_chain(dc.F.col("_chains"))).withColumn("end", dc.conclusion_strategy(dc.F.col("_flow"))).first()
    assert r._chains == [[], ["interpretation", "technique", "implication"]] and r.typical == "observation" and r.end == "extends to wider implications"
