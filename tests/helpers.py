"""Small writers and readers the tests share."""

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F


def ms(text, milli=0):
    """Epoch milliseconds of a UTC time."""
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1000 + milli


def vehicle(codigo, linha, trajeto, velocidade=10.0, when="2017-08-27 10:00:00", **more):
    return {
        "codigo": codigo,
        "linha": linha,
        "latitude": -22.9,
        "longitude": -43.4,
        "datahora": ms(when, 789),
        "velocidade": velocidade,
        "id_migracao": 1.0,
        "sentido": "ida",
        "trajeto": trajeto,
        **more,
    }


def write_snapshot(folder, stamp, vehicles, raw=None):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"snap_{stamp}.json"
    path.write_text(raw if raw is not None else json.dumps({"veiculos": vehicles}), encoding="utf-8")
    return path


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def times_as_text(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
