import __spark_entry__ as entry

IDS = (["n9", "s1", "s3", "s4", "s5"] + [f"k{i}" for i in range(1, 5)] + [f"n{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 10)]
       + [f"c{i}" for i in range(1, 6)] + [f"d{i}" for i in range(1, 4)] + [f"v{i}" for i in range(1, 7)]
       + [f"o{i}" for i in range(1, 4)] + [f"j{i}" for i in range(1, 6)] + [f"x{i}" for i in range(1, 8)]
       + [f"p{i}" for i in range(2, 7)] + [f"q{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15)]
       + [f"g{i}" for i in range(1, 5)] + [f"r{i}" for i in range(0, 8)] + [f"st{i}" for i in range(1, 7)])


def test_every_survey_id_has_a_query():
    names = entry.queries()
    missing = [i for i in IDS if not any(n.startswith(i + "_") for n in names)]
    assert missing == []


def test_every_query_has_an_oracle():
    from tersus.suite.registry import ORACLE as o, QUERIES as q
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(o) <= set(q)
    assert set(q) == set(o)
