"""Decision-support programs over tables passed in by role.

``columns`` says which column plays which role, so the programs run on any star schema.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R


def returns_above_average(returns: DataFrame, stores: DataFrame, customers: DataFrame, *, customer: str, store: str, amount: str, store_key: str, customer_key: str, customer_id: str, store_filter: Column, strict_spec: bool = False) -> DataFrame:
    """Ids of customers whose returns at a store exceed the store's average (1.2 times it and at most 100 ids with strict_spec).

    The average is over the joined rows: stores that the filter keeps, customers that exist.
    """
    total = R.group_sum(returns, [customer, store], amount, "total")
    total = total.join(customers.select(F.col(customer_key).alias("__c"), F.col(customer_id).alias("__id")), F.col(customer) == F.col("__c"))
    total = total.join(stores.where(store_filter).select(F.col(store_key).alias("__s")), F.col(store) == F.col("__s"))
    # the joins go before both the mean and the join back to it; the totals are small beside the returns they come from
    above = R.with_group_avg(total, store, "total").where(F.col("total").cast("double") > F.col("group_avg").cast("double") * (1.2 if strict_spec else 1.0))
    ids = above.select(F.col("__id").alias(customer_id)).distinct().orderBy(customer_id)
    return ids.limit(100) if strict_spec else ids


def returns_above_average_partitioned(returns: DataFrame, stores: DataFrame, customers: DataFrame, n: int, **roles) -> DataFrame:  # noqa: ANN003
    """The same with returns and customers dealt into n partitions by customer first."""
    c, k = roles["customer"], roles["customer_key"]
    kept = R.partitioned_join(returns, customers.select(F.col(k).alias(c)), c, n)
    return returns_above_average(kept, stores, customers, **roles)


@dataclass(frozen=True)
class OrderRoles:
    order: str
    warehouse: str
    ship_date: str
    ship_cost: str
    profit: str


def multi_warehouse_orders(sales: DataFrame, returned: DataFrame, roles: OrderRoles, dates: tuple[str, str], dims: list[tuple[DataFrame, str, str]], strict_spec: bool = False, order_list: DataFrame | None = None) -> DataFrame:
    """Orders shipped from more than one warehouse, also in the returns list (not in it with strict_spec), shipped strictly between
    two dates and with a partner in each filtered dimension (table, sales key, dimension key): distinct orders, cost and profit.

    order_list: the multi-warehouse orders as a stage made before; else they are found here.
    """
    many = order_list if order_list is not None else R.keys_with_many(sales, roles.order, roles.warehouse)
    found = sales.where(_strictly_between(roles.ship_date, *dates))
    for dim, key, dim_key in dims:
        found = R.semi_join(found, dim, key, dim_key)
    found = R.semi_join(found, many, roles.order, roles.order)
    found = (R.anti_join if strict_spec else R.semi_join)(found, returned, roles.order, roles.order)
    return found.agg(F.countDistinct(roles.order).alias("orders"), F.coalesce(F.sum(roles.ship_cost), F.lit(0)).alias("ship_cost"), F.coalesce(F.sum(roles.profit), F.lit(0)).alias("profit"))


def _strictly_between(c: str, low: str, high: str) -> Column:
    """Bounds on the stored column itself, so they reach the scan: after the day low, before the day high."""
    return (F.col(c) >= F.date_add(F.lit(low).cast("date"), 1).cast("timestamp_ntz")) & (F.col(c) < F.lit(high).cast("timestamp_ntz"))
