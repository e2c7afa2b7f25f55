"""Figures of an investment: plain arithmetic on columns. Divisions by nothing give 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column, places: int = 4) -> Column:
    return F.when(b <= 0, 0.0).otherwise(F.round(a / F.when(b > 0, b), places))


def level_payment(principal: Column, rate: Column, years: Column) -> Column:
    """The monthly payment that pays a loan off; without interest equal parts; nothing for no loan or no time."""
    n, r = years * 12, rate / 12
    grown = F.pow(1 + r, n)
    return F.when((principal <= 0) | (years <= 0), 0.0).when(rate <= 0, F.round(principal / n, 2)).otherwise(F.round(principal * r * grown / (grown - 1), 2))


def cash_flow(rent: Column, vacancy: Column, other: Column, costs: Column, debt: Column) -> Column:
    """A struct of the month: effective income, operating income, what is left, and that for a year; each rounded to cents."""
    income = F.round(rent * (1 - vacancy) + other, 2)
    operating = F.round(income - costs, 2)
    left = F.round(operating - debt, 2)
    return F.struct(income.alias("income"), operating.alias("operating"), left.alias("month"), F.round(left * 12, 2).alias("year"))


def cap_rate(operating_year: Column, price: Column) -> Column:
    return _ratio(operating_year, price)


def cash_on_cash(flow_year: Column, cash: Column) -> Column:
    return _ratio(flow_year, cash)


def rent_multiplier(price: Column, rent_year: Column) -> Column:
    return _ratio(price, rent_year, 2)


def debt_cover(operating_year: Column, debt_year: Column) -> Column:
    return _ratio(operating_year, debt_year, 2)


def break_even(costs: Column, debt: Column, rent: Column) -> Column:
    return _ratio(costs + debt, rent)


def one_percent(price: Column, rent: Column) -> Column:
    return (price > 0) & (rent >= price * 0.01)


def analysis(price: Column, down: Column, rate: Column, years: Column, rent: Column, vacancy: Column, costs: Column, closing: Column) -> Column:
    """A struct of all figures of a purchase. The year's operating income is twelve times the month's rounded one."""
    loan = F.round(price * (1 - down), 2)
    debt = level_payment(loan, rate, years)
    flow = cash_flow(rent, vacancy, F.lit(0.0), costs, debt)
    noi = flow["operating"] * 12
    cash = price * down + closing
    return F.struct(
        loan.alias("loan"), debt.alias("debt"), flow["month"].alias("flow"), F.round(noi, 2).alias("noi"), cap_rate(noi, price).alias("cap_rate"), cash_on_cash(flow["year"], cash).alias("cash_on_cash"),
        debt_cover(noi, debt * 12).alias("debt_cover"), break_even(costs, debt, rent).alias("break_even"), one_percent(price, rent).alias("one_percent"),
    )


def problem(*, price: Column, rate: Column, years: Column, amounts: dict[str, Column]) -> Column:
    """What is wrong with the input of an analysis, the first thing found, or null: ranges of years and rates, a positive price, no negative amounts."""
    out = F.when(price.isNull(), "price is required").when(price <= 0, "price must be greater than zero")
    out = out.when(~years.between(1, 50), "years must be between 1 and 50").when(~rate.between(0.0, 1.0), "rate must be between 0 and 1")
    for name, c in amounts.items():
        out = out.when(c < 0, f"{name} cannot be negative")
    return out
