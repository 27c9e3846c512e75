"""Which statements run, and why the others do not."""

import pytest

from servicelens.sources import statements

ALLOWED = {
    "select 1",
    "select * from kpi;",
    "SELECT department, sum(n) AS n FROM KPI GROUP BY department HAVING sum(n) > 0 ORDER BY 2 DESC LIMIT 3",
    "with c as (select * from kpi), d as (select * from c) select count(*) from d join c on c.n = d.n",
    "select * from kpi a left join kpi b on a.n = b.n and b.n between 1 and 3 where a.n not in (2)",
    "select n, row_number() over (partition by department order by n) as r from kpi",
    "select * from kpi where n = (select max(n) from kpi) union all select * from kpi",
    "with secret as (select 1 as n) select * from secret",
    "select case when n > 1 then 'a' else upper(department) end from kpi",
    "select * from (values (1), (2)) as t(n)",
}
REFUSED = {
    None: "empty",
    "  ": "empty",
    "selec 1": "syntax",
    "select 1; select 2": "syntax",
    "drop table kpi": "command",
    "insert into kpi values (1)": "command",
    "create table x as select 1": "command",
    "create temporary view kpi as select 1": "command",
    "set spark.sql.ansi.enabled = false": "command",
    "explain select 1": "command",
    "cache table kpi": "command",
    "describe kpi": "command",
    "select * from secret": "relation",
    "select * from default.kpi": "relation",
    "select * from parquet.`/tmp/x`": "relation",
    "select (select max(n) from secret) from kpi": "relation",
    "select * from kpi where exists (select 1 from secret)": "relation",
    "select * from kpi where n in (select n from kpi where n > (select min(n) from secret))": "relation",
    # a CTE's name does not reach beyond its query, nor into definitions before its own
    "select * from secret where exists (with secret as (select 1) select * from secret)": "relation",
    "with a as (select * from secret), secret as (select 1) select * from a": "relation",
    "with secret as (select * from secret) select * from secret": "relation",
    "select * from range(3)": "node",
    "select * from (with c as (select 1) select * from c)": "",
    "select transform(n) using 'cat' from kpi": "command",
    "select reflect('java.lang.System', 'getenv') from kpi": "function",
    "select n from kpi order by java_method('a', 'b')": "function",
    "select * from kpi where n in (select my_udf(n) from kpi)": "function",
    "select count(*) filter (where reflect('a', 'b') = 1) from kpi": "function",
}


@pytest.fixture(scope="module")
def kpi(spark):
    spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "department string, n int").createOrReplaceTempView("kpi")
    spark.range(3).createOrReplaceTempView("secret")
    return spark


@pytest.mark.parametrize("statement", sorted(ALLOWED))
def test_allowed(kpi, statement):
    assert statements.check_statement(kpi, statement, ["kpi"]).allowed
    statements.run_statement(kpi, statement, ["kpi"]).collect()


@pytest.mark.parametrize("statement", REFUSED)
def test_refused(kpi, statement):
    verdict = statements.check_statement(kpi, statement, ["kpi"])
    if REFUSED[statement]:
        assert (verdict.allowed, verdict.reason) == (False, REFUSED[statement])
        with pytest.raises(ValueError, match="refused: " + REFUSED[statement]):
            statements.run_statement(kpi, statement, ["kpi"])


def test_limit(kpi):
    assert statements.run_statement(kpi, "select * from kpi", ["kpi"], limit=2).count() == 2
    assert statements.run_statement(kpi, "select * from kpi limit 1", ["kpi"], limit=2).count() == 1
    assert statements.run_statement(kpi, "select * from kpi", ["KPI"]).count() == 3
