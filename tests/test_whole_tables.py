"""Queries over whole tables, by brute force."""

from itertools import combinations

from tessel import plans
from tessel.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_whole_tables(spark):
    t = Tables(spark, SF)
    run = lambda name: [tuple(r) for r in plans.QUERIES[name](spark, SF).collect()]
    orders = [tuple(r) for r in t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").collect()]
    by_customer = {}
    for key, customer, _ in orders:
        by_customer.setdefault(customer, []).append(key)
    assert sorted(run("join_self_whole")) == sorted(pair for keys in by_customer.values() for pair in combinations(sorted(keys), 2))
    assert sorted(run("statement_insert_select_returning_whole")) == sorted((10 * key, s) for key, _, s in orders)
    customers = [(r.c_custkey, -r.c_acctbal) for r in t.customer.select("c_custkey", "c_acctbal").collect()]
    assert run("sort_alias_position_whole") == sorted(customers, key=lambda c: (c[1], c[0]))
    assert run("sort_alias_whole") == sorted(customers, key=lambda c: (-c[1], c[0]))
