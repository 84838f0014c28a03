"""Settings that registered queries rely on."""

KEY = "spark.sql.codegen.hugeMethodLimit"


def test_queries_compile_wide_stages_in_any_session(spark):
    from dealscope.plans import catalog
    from tests.conftest import SF_SMOKE

    plain = spark.newSession()
    plain.conf.set(KEY, "65535")
    df = catalog.queries()["clean_work_orders"](plain, SF_SMOKE)
    assert int(plain.conf.get(KEY)) <= 8000
    plain.conf.set(KEY, "4000")  # a smaller limit stays
    catalog.queries()["clean_work_orders"](plain, SF_SMOKE)
    assert plain.conf.get(KEY) == "4000" and len(df.columns) == 42
