from marginalia.shipping import ship


def test_modules_reach_the_session_once(spark):
    ship(spark)
    ship(spark)
    assert [f for f in spark.sparkContext.listFiles if "marginalia_modules" in f].__len__() == 1
