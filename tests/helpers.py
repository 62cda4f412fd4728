"""Comparison with DuckDB, and damaged copies of the tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def oracle(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=repr)


#: Columns that operators use inside; a table may have its own.
CLASHES = ("rep", "n", "w", "t", "s", "x", "text2", "l", "hs", "seg", "segs", "pos", "start", "end", "n_tokens", "ref_key", "salt", "hot", "damage", "piece_no", "size", "bucket", "rank", "field", "grp", "label", "known", "reason", "copies", "q", "_r")


def variant(sf_dir: str, to: Path, kind: str) -> str:
    """A copy of the tables: ``clash`` with more columns, ``empty`` without rows, ``nulls`` with a row of nulls for each
    column but the key, and one of nulls only."""
    to.mkdir(parents=True, exist_ok=True)
    for f in Path(sf_dir).glob("*.parquet"):
        t = pq.read_table(f)
        if kind == "clash":
            for c in CLASHES:
                if c not in t.column_names:
                    t = t.append_column(c, pa.array([f"{c}{i % 3}" for i in range(len(t))]))
        elif kind == "empty":
            t = t.slice(0, 0)
        elif kind == "nulls" and len(t):
            key = t.column_names[0]
            extra = []
            for i, name in enumerate([*t.column_names[1:], None]):
                row = t.slice(i % len(t), 1)
                cols = []
                for c in t.column_names:
                    fld = t.schema.field(c)
                    if c == name or name is None:
                        cols.append(pa.nulls(1, fld.type))
                    elif c == key:
                        cols.append(pa.array([f"null-{i}"], fld.type) if pa.types.is_string(fld.type) else pa.array([10_000_000 + i], fld.type))
                    else:
                        cols.append(row.column(c).combine_chunks())
                extra.append(pa.table(cols, schema=pa.schema([pa.field(x.name, x.type) for x in t.schema])))
            t = pa.concat_tables([t.cast(extra[0].schema), *extra])
        pq.write_table(t, to / f.name)
    return str(to)
