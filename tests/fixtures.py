"""Schemas and rows that many tests use."""

import random

from tessera import BOOL, FLOAT, INT, STRING, Schema

ALL = Schema(["bool", "int", "string", "float"], [BOOL, INT, STRING(5), FLOAT])
ONE_INT = Schema(["int"], [INT])
CONSTANT = (True, 1, "abcde", 1.2)


def valued(v):
    return (True, v, str(v).rjust(5, "0"), float(v))


def random_rows(n, seed=7):
    rng = random.Random(seed)
    return [(rng.random() < 0.5, i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(5)), rng.random()) for i in range(n)]


def fill(database, name, rows, schema=ALL, indices=()):
    database.create_table_with_indices(schema, name, list(indices))
    with database.begin_transaction() as t:
        t.add_records(name, rows)
