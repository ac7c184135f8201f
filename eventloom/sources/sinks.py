"""Where tables go: files by format, named after their stage."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame

#: File extension to the name of pandas' writer, where they differ.
WRITERS = {"xlsx": "excel", "h5": "hdf", "hd5": "hdf", "msg": "msgpack", "dta": "stata", "pkl": "pickle", "p": "pickle"}
#: Formats that Spark writes itself, as a folder of files.
FOLDERS = {"parquet", "orc", "avro"}


def formats(config: Any) -> list[dict]:
    """``file_format`` as a list of ``{extension, **options}``."""
    if config is None:
        return [{"extension": ".csv", "float_format": "%.17g"}]
    if not isinstance(config, list):
        config = [config]
    out = []
    for item in config:
        item = {"extension": item} if isinstance(item, str) else dict(item)
        if "extension" not in item:
            raise ValueError(f"file format {item!r} has no extension")
        if not item["extension"].startswith("."):
            item["extension"] = "." + item["extension"]
        out.append(item)
    return out


#: Rows of a table that one file on the driver takes.
MOST_ROWS = 2_000_000


def _bounded(df: DataFrame, name: str) -> Any:
    frame = df.limit(MOST_ROWS + 1).toPandas()
    if len(frame) > MOST_ROWS:
        raise ValueError(f"{name} has more than {MOST_ROWS} rows; write it as one of {sorted(FOLDERS)}")
    return frame


def write_table(df: DataFrame, out_dir: str, name: str, config: Any = None) -> list[str]:
    """Writes a result table in each format; one whose writer is missing is reported and left out, other failures raise.

    Result tables are a row for each bin or cut, so formats of one file go through the driver, up to MOST_ROWS of them;
    columnar formats are written by Spark.
    """
    os.makedirs(out_dir, exist_ok=True)
    made, frame = [], None
    for item in formats(config):
        options = {k: v for k, v in item.items() if k != "extension"}
        extension = item["extension"]
        kind = extension[1:].split(".")[0]
        path = os.path.join(out_dir, name if name.endswith(extension) else name + extension)
        try:
            if kind in FOLDERS:
                df.write.mode("overwrite").options(**options).format(kind).save(path)
            else:
                frame = _bounded(df, name) if frame is None else frame
                writer = getattr(frame, "to_" + WRITERS.get(kind, kind), None)
                if writer is None:
                    raise ImportError(f"no writer of {extension}")
                if kind == "csv":
                    options = {"index": False} | options
                if WRITERS.get(kind) == "hdf":
                    options = {"key": "df", "mode": "w"} | options
                writer(path, **options)
            made.append(path)
        except ImportError as e:
            print(f"cannot write {path}: {e}")
    return made


def write_events(df: DataFrame, out_dir: str, name: str) -> list[str]:
    """Writes event-level rows as a Parquet folder, by the executors."""
    path = os.path.join(out_dir, name)
    df.write.mode("overwrite").parquet(path)
    return [path]


def write_json(held: dict, out_dir: str, name: str) -> list[str]:
    os.makedirs(out_dir, exist_ok=True)
    path = os.path.join(out_dir, name)
    with open(path, "w") as f:
        json.dump(held, f, indent=1)
    return [path]
