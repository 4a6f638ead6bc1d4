"""Registered queries over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from behaviorlens.plans import behaviour, records, reports, reviewing, standards

CATALOGUES = (behaviour.CATALOGUE, records.CATALOGUE, reviewing.CATALOGUE, reports.CATALOGUE, standards.CATALOGUE)


def queries():
    return {name: run for catalogue in CATALOGUES for name, (run, _) in catalogue.items()}


def oracle_sql():
    return {name: sql for catalogue in CATALOGUES for name, (_, sql) in catalogue.items() if sql}


def flagship(spark, sf_dir):
    return queries()["scored_windows"](spark, sf_dir)
