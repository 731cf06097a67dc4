"""Every catalogue query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from factloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def canonical(rows):
    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6)
        return x

    return sorted(([cell(x) for x in r] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    rows = canonical(tuple(r) for r in got.select(*columns).collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == columns
    assert rows == canonical(duck.sql(f'SELECT {", ".join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})').fetchall())


def test_dataflow_fold_matches_brute_force(spark, duck):
    rows = duck.sql("SELECT user_id, event_type, event_id, json_extract_string(props, '$.k')::BIGINT AS symbol FROM events ORDER BY user_id, ts, event_id").fetchall()
    units, want, kinds = {}, set(), set()
    for user, kind, event, symbol in rows:
        units.setdefault(user, []).append((kind, f"v{event % 7}", f"v{symbol % 7}"))
    join = lambda x: ",".join(sorted(x))
    for user, events in units.items():
        outer, at = {"v0"}, 0  # names live outside all branches
        while at < len(events):
            kind, read, name = events[at]
            if kind != "purchase":  # before the first purchase
                want.add((str(user), 2 * at + 2, join(outer), name, read))
                outer, at = outer | {name}, at + 1
                continue
            end = next((k for k in range(at + 1, len(events)) if events[k][0] == "purchase"), len(events))
            defined, used = set(), set()
            for k in range(at + 1, end):
                want.add((str(user), 2 * k + 2, join(outer | defined), events[k][2], events[k][1]))
                used |= {events[k][1]} - defined
                defined |= {events[k][2]}
            want.add((str(user), 2 * at + 2, join(outer), join(defined), join(used | {name})))
            want.add((str(user), 2 * at + 3, join(outer), join(defined), join(used)))
            kinds.add(bool(defined))
            outer, at = outer | defined, end
    got = catalog.queries()["dataflow_fold"](spark, DIR)
    assert {tuple(r) for r in got.select("unit", "node_id", "live", "defines", "uses").collect()} == want and True in kinds
