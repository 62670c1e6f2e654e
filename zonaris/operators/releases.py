"""Imports in stages: layers are checked, written aside, judged by a gate, and shown all at once by a manifest.

A store is a folder: `data/<release>/<layer>` holds accepted rows, `rejects/<run>/<layer>` what was refused and why, and `manifests/<number>.json` names the release
that is shown. Readers take the greatest number, or pin one. Data are never changed once a manifest names them, a manifest is made by one rename, and going
back is a new manifest that names an older release; so a reader sees either the old release or the new one, whatever fails in between.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonaris.sources import files
from zonaris.sources.shared import delete

Rules = Sequence[tuple[str, Column]]


@dataclass(frozen=True)
class Gate:
    """When a run is shown: at most this share of a layer's rows rejected, these layers not empty, and no layer smaller than the shown one by
    more than a share of it (at least `floor` rows)."""

    rejected: float = 0.05
    required: tuple[str, ...] = ()
    loss: float = 0.1
    floor: int = 5


@dataclass
class Outcome:
    """status: activated, unchanged, or refused with reasons; counts by layer."""

    status: str
    number: int | None
    release: str | None
    reasons: list[str] = field(default_factory=list)
    layers: dict[str, dict[str, int]] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def manifests(spark: SparkSession, root: str) -> dict[int, dict]:
    """The manifests of a store by number."""
    fs, folder = _fs(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return {}
    named = {m[1] for s in fs.listStatus(folder) if (m := re.fullmatch(r"(\d+)\.json", s.getPath().getName()))}
    if not named:
        return {}
    texts = spark.read.text([f"{root}/manifests/{n}.json" for n in sorted(named)], wholetext=True).collect()  # a few hundred bytes for each release
    return {m["number"]: m for m in (json.loads(r["value"]) for r in texts)}


def shown(spark: SparkSession, root: str, number: int | None = None) -> dict | None:
    """The manifest that is shown now, or the pinned one; null in an empty store. LookupError for a number that is not there."""
    held = manifests(spark, root)
    if number is not None and number not in held:
        raise LookupError(f"no manifest {number}")
    return held[max(held) if number is None else number] if held else None


def _publish(spark: SparkSession, root: str, manifest: dict) -> None:
    """Write a manifest aside and rename it to its number; FileExistsError if another run took that number first."""
    path = f"{root}/manifests/{manifest['number']}.json"
    fs, aside = _fs(spark, f"{root}/manifests/_{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True, ensure_ascii=False).encode()))
    out.close()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise FileExistsError(path)


def checked(rows: DataFrame, rules: Rules) -> DataFrame:
    """`rows` with `reject_reason`: the first rule whose condition holds, or null. A condition that is null does not hold."""
    reason = reduce(lambda rest, r: F.when(F.coalesce(r[1], F.lit(False)), r[0]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))
    return rows.withColumn("reject_reason", reason)


def content_hash(rows: DataFrame) -> str:
    """A hash of the rows as a bag: equal rows in any order and partitions give equal text; one aggregation."""
    columns = sorted(rows.columns)
    text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"})
    parts = [F.sum(F.conv(F.substring(F.sha2(text, 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"h{k}") for k in range(4)]
    got = rows.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256(json.dumps([columns, *(str(v or 0) for v in got)]).encode()).hexdigest()


def run_import(spark: SparkSession, root: str, layers: Mapping[str, DataFrame], rules: Mapping[str, Rules], gate: Gate = Gate(), force: bool = False) -> Outcome:  # noqa: B008
    """Import layers into the store at `root` (a folder that the whole cluster reaches).

    Rows that a rule rejects go to `rejects` with their reason. What is accepted is written under a new release; a gate that fails leaves the shown release as it is
    and deletes the new data. Equal content is `unchanged`: nothing is shown anew, and running twice changes nothing. `force` passes the guard against loss, not the rest.
    """
    run = uuid.uuid4().hex
    out = Outcome("refused", None, None)
    before = shown(spark, root)
    hashes = {}
    try:
        for name in sorted(layers):
            judged = checked(layers[name], rules.get(name, ()))
            path = f"{root}/data/{run}/{name}"
            judged.write.partitionBy("reject_reason").parquet(f"{root}/staging/{run}/{name}")
            staged = spark.read.schema(judged.schema).parquet(f"{root}/staging/{run}/{name}")  # read from here on: the source is read once
            good = staged.where("reject_reason is null").drop("reject_reason")
            good.write.parquet(path)
            staged.where("reject_reason is not null").write.parquet(f"{root}/rejects/{run}/{name}")
            counts = {r["reject_reason"]: r["count"] for r in staged.groupBy("reject_reason").count().collect()}  # one row for each reason
            out.layers[name] = {"read": sum(counts.values()), "accepted": counts.pop(None, 0), **counts}
            hashes[name] = content_hash(spark.read.schema(good.schema).parquet(path))
        out.release = hashlib.sha256(json.dumps(hashes, sort_keys=True).encode()).hexdigest()
        out.reasons = _judged(out.layers, gate, before, force)
        if not out.reasons and before and before["content"] == out.release:
            out.status, out.number = "unchanged", before["number"]
        elif not out.reasons:
            number = before["number"] + 1 if before else 1
            _publish(spark, root, {"number": number, "run": run, "content": out.release, "layers": out.layers, "kind": "import"})
            out.status, out.number = "activated", number
        return out
    finally:
        delete(spark, f"{root}/staging/{run}")
        if out.status != "activated":
            delete(spark, f"{root}/data/{run}")


def _judged(layers: dict[str, dict[str, int]], gate: Gate, before: dict | None, force: bool) -> list[str]:
    """Why a run must not be shown."""
    why = [f"{n}: too many rejected" for n, c in layers.items() if c["read"] and 1 - c["accepted"] / c["read"] > gate.rejected]
    why += [f"{n}: empty" for n in gate.required if not layers.get(n, {}).get("accepted")]
    old = before["layers"] if before and not force else {}
    why += [f"{n}: lost too many" for n, c in old.items() if c["accepted"] - layers.get(n, {"accepted": 0})["accepted"] > max(gate.floor, gate.loss * c["accepted"])]
    return why


def roll_back(spark: SparkSession, root: str, number: int | None = None) -> Outcome:
    """Show the release before the shown one anew (going on back from there next time), or that of manifest `number`; LookupError if there is none."""
    held, now = manifests(spark, root), shown(spark, root)
    if now is None:
        raise LookupError("an empty store")
    of = now.get("of", now["number"])  # a release shown anew stands where it was first shown
    older = [n for n, m in held.items() if m["kind"] == "import" and n < of] if number is None else [n for n in held if n == number]
    if not older:
        raise LookupError("no older release")
    back = held[max(older)]
    new = {**back, "number": now["number"] + 1, "kind": "rollback", "of": back.get("of", back["number"])}
    _publish(spark, root, new)
    return Outcome("activated", new["number"], new["content"], [], new["layers"])


def read(spark: SparkSession, root: str, layer: str, number: int | None = None) -> DataFrame:
    """A layer of the shown release, or of a pinned manifest."""
    m = shown(spark, root, number)
    if m is None or layer not in m["layers"]:
        raise LookupError(f"no layer {layer}")
    return spark.read.parquet(f"{root}/data/{m['run']}/{layer}")


def rejects(spark: SparkSession, root: str, layer: str) -> DataFrame:
    """(the layer's columns, reject_reason, run) of all runs."""
    return spark.read.parquet(f"{root}/rejects/*/{layer}").withColumn("run", F.regexp_extract("_metadata.file_path", "/rejects/([0-9a-f]+)/", 1))


def geojson_layers(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The layers `<name>.geojson` of a folder, each a table of features (`files.read_geojson`)."""
    return {n: files.read_geojson(spark, f"{path}/{n}.geojson") for n in names}
