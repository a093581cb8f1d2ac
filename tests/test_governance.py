"""Gates, lineage, envelopes, questions, masking and binding."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from quarrystone.functions import binding, pii, retrieval, scalar
from quarrystone.plans import envelope, governance, questions
from quarrystone.plans.model import sales
from quarrystone.plans.outcomes import Refusal


def test_hostile_text_and_plans(spark):
    for s, reason in {"select 'drop' as drop from t": "statement_not_allowed", "ATTACH 'x'": "path_not_allowed", "with a as (select 1) select * from a, b": "table_not_granted", "values (1)": "statement_not_allowed", "": "statement_not_allowed"}.items():
        assert governance.gate(spark, s, {"t"}).reason == reason, s
    assert not isinstance(governance.gate(spark, "select * from T where x in (select y from t)", {"t"}), Refusal)
    nested = "with t as (select * from t) select * from t"
    assert governance.gate(spark, nested, set()).reason == "table_not_granted"
    assert governance.gate(spark, "select * from a union select * from b", {"a"}).reason == "table_not_granted"
    assert governance.query(spark, "select nope from t9", {"t9"}).reason == "sql_error"


def test_grounds_and_dropped_conjuncts(spark):
    a = governance.parsed(spark, "select k, sum(v) s from t where x = 1 and y > 2 group by k order by s desc limit 3 offset 1")
    g = governance.grounds(a)
    assert len(g.conjuncts) == 2 and g.limit == "3" and g.offset == "1" and not g.open_ and g.order
    b = governance.parsed(spark, "select k, sum(v) s from t where x = 1 group by k")
    assert len(governance.dropped_conjuncts(a, b)) == 1
    assert governance.grounds(governance.parsed(spark, "select 1 from t where a = 1 or b = 2")).open_


def test_currency_and_types(spark):
    df = spark.createDataFrame([("MYR", "1", 2.0), (" myr", "2", 3.0)], "cur string, txt string, amt double")
    df.createOrReplaceTempView("ledger_view")
    assert governance.currency_of(df, "cur") == "MYR"
    out = spark.sql("select sum(amt) as a, sum(cast(txt as double) + amt) as b from ledger_view")
    assert governance.tables_read(out) == {"ledger_view"}
    assert governance.untyped_numeric(out, {"ledger_view": {"txt"}}).detail.startswith("b")
    money = {("ledger_view", "amt"): "MYR", ("ledger_view", "txt"): "USD"}
    assert governance.currency_mismatch(out, money).reason == "currency_mismatch" and governance.currency_mismatch(out.select("a"), money) is None
    assert governance.schema_fingerprint(df) == governance.schema_fingerprint(df.select("amt", "txt", "cur"))
    dates = spark.createDataFrame([("31/12/2024",), ("01/02/2024",)], "d string")
    assert governance.date_format(dates, "d") == "dd/MM/yyyy"


def test_questions_and_envelopes(spark, small):
    o = sales(spark, small)
    q = questions.ask("top 3 revenue by brand", o)
    e = envelope.build(q, "top 3 revenue by brand", ["lineitem"], "a1")
    assert len(e["rows"]) == 3 and envelope.problems(e) == [] and not envelope.shape_mismatch(e["question"], q)
    assert "E13" in envelope.problems(e | {"prose": "The total is 123,456,789.99"})
    assert envelope.problems(e | {"badge": "ABSTAIN"})[0] == "E1" and "E8" in envelope.problems(e | {"as_of": "2999-01-01T00:00:00+00:00"})
    grey = envelope.build(questions.ask("weather tomorrow", o), "weather", [], "a2")
    assert grey["badge"] == "ABSTAIN" and envelope.problems(grey) == []
    assert questions.rank_window("ranks 4-8") == questions.RankWindow(4, 8) and questions.rank_window("ranks 8-4").limit == 0
    w = questions.rank_window("top 10 suppliers excluding the top 3")
    assert (w.offset, w.limit) == (3, 7) and not questions.rank_window("lowest 2").descending
    assert questions.unhonored("revenue in 2024", {"filters": []}).detail == "time=2024"
    assert questions.follow_up("average of those", [1.0, 3.0]) == 2.0 and questions.follow_up("add 5", [1.0]) == 6.0
    assert envelope.chart(e["rows"])["kind"] == "bar"


def test_audit_and_exports(spark, small, tmp_path):
    e = envelope.build(Refusal("no_path"), "q", [], "a3", datetime(2024, 1, 1, tzinfo=timezone.utc))
    envelope.audit(spark, str(tmp_path / "audit"), e)
    envelope.audit(spark, str(tmp_path / "audit"), e)
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    df = spark.createDataFrame([("=1+1", 2), ('a"b,c', 3)], "t string, n int")
    envelope.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted(r.t for r in back.collect()) == ["'=1+1", 'a"b,c']


def test_masking(spark):
    df = spark.createDataFrame([("a@b.co", "900101-14-5566", "4111 1111 1111 1111", 5.0, "x"), ("c@d.org", "900101-14-5567", "5500 0000 0000 0004", 6.0, "y")], "contact string, ref string, pay string, amount double, customer_name string")
    kinds = pii.classify_columns(df, "orders")
    assert kinds == {"contact": "email", "ref": "nric", "pay": "card", "customer_name": "name"}
    numbers = spark.createDataFrame([("4111 1111 1111 1111 and 4111 1111 1111 1112",)], "t string")
    assert numbers.select(pii.cards(F.col("t"))).first()[0] == ["4111 1111 1111 1111"]
    m = pii.Masker()
    rows = m.rows([{"customer_name": "x", "note": "mail a@b.co"}, {"customer_name": "x", "note": "a@b.co"}], kinds)
    assert rows == [{"customer_name": "MASK_name_01", "note": "mail MASK_email_01"}, {"customer_name": "MASK_name_01", "note": "MASK_email_01"}]


def test_binding(spark):
    t = {"a": spark.createDataFrame([("Kuala Lumpur ",), ("Côte d'Ivoire",), (None,)], "city string"), "b": spark.createDataFrame([("kuala lumpur",)], "place string")}
    found = binding.index(t)
    pack = binding.TermPack("cities", {"Kuala Lumpur": ("KL",), "Cote d Ivoire": ()})
    assert binding.certify(pack, "kl", found).status == "ABSTAIN"
    assert binding.certify(pack, "Côte d'Ivoire", found).values == ("Côte d'Ivoire",)
    assert binding.certify(pack, "Paris", found).status == "REFUSE"
    assert binding.polarity("all except kl", "kl") == "exclude" and binding.polarity("kl but not kl", "kl") == "unsettled"
    assert binding.cascade("sales in cote d ivoire", [pack], found)[0][1].status == "CERTIFIED"
    assert binding.exact(t["a"], "city", ["Kuala Lumpur "], "kuala lumpur") is True
    assert binding.exact(t["a"], "city", ["Kuala Lumpur "], "kuala lumpur", negative=True).reason == "unhonored_qualifier"
    assert scalar.fold("SKU-BETA") == "sku beta" and scalar.quote("a`b") == "`a``b`"
    assert scalar.result_hash([{"a": 1.0, "b": None}, {"a": 2, "b": "x"}]) == scalar.result_hash([(2.0, "x"), (1, None)])


def test_retrieval(spark):
    text = "one\n\ntwo words\n\n" + "x" * 25 + "\n\nend"
    got = spark.range(1).select(retrieval.chunks(F.lit(text), 20)).first()[0]
    assert got == ["one\n\ntwo words", "x" * 20, "x" * 5, "end"]
    assert spark.range(1).select(retrieval.chunks(F.lit(None).cast("string"))).first()[0] == []
    docs = spark.createDataFrame([(0, "red apple pie"), (1, "green apple"), (2, "")], "chunk_index int, text string")
    assert [r.chunk_index for r in retrieval.search_chunks(docs, "red apple").collect()] == [0, 1]
    sims = spark.range(1).select(retrieval.trigram_similarity(F.lit("orders"), F.lit("order")).alias("a"), retrieval.trigram_similarity(F.lit("orders"), F.lit("zzz")).alias("b")).first()
    assert sims.a > 0.6 and sims.b == 0.0
    assert spark.range(1).select(F.aggregate(retrieval.hashed_vector(F.lit("abc")), F.lit(0.0), lambda s, x: s + x)).first()[0] == 3.0
