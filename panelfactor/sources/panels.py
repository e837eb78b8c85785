"""Panel readers: Parquet observations, strict CSV, verified snapshots, injected live sources and their cache."""

from __future__ import annotations

import contextlib
import gzip
import hashlib
import importlib.resources
import io
import json
import os
import time
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DataConfig
from ..operators import panel, quality
from ..schema import DATE, PANEL, Nodes
from .live import BASE, INVALID, UNAVAILABLE, PayloadInvalid, SourceUnavailable, http_fetch, live_source


@dataclass(frozen=True)
class Provenance:
    mode: str
    location: str
    sha256: str
    acquired_at: str
    rows: int
    first_date: str
    last_date: str
    error: str | None = None


def read_parquet_panel(spark: SparkSession, path: str, date, node, value, nodes, panel_column=None) -> DataFrame:
    """Wide daily panel of a Parquet table of observations; only the named columns are read."""
    return panel.daily_nodes(spark.read.parquet(path), F.lit("curve") if panel_column is None else panel_column, date, node, value, nodes)


def read_csv_panel(spark: SparkSession, path: str, nodes: Nodes, config: DataConfig) -> DataFrame:
    """Wide daily panel of a CSV file (plain or gzip), read as text so that bad tokens are refused, not nulled."""
    raw = spark.read.option("header", True).csv(path)
    typed, defects = panel.parse_panel(raw, nodes, config.start_date, config.end_date)
    panel.refuse_defects(defects)
    if not panel.complete(typed, config.core_tenors).limit(1).count():
        raise ValueError("no day has all core nodes")
    return typed


def file_digest(spark: SparkSession, path: str) -> tuple[int, str]:
    """Size and SHA-256 of one file, wherever Spark can read it."""
    r = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("sha")).first()
    return int(r.length), r.sha


def read_manifest(spark: SparkSession, path: str) -> dict:
    rows = spark.read.format("binaryFile").load(path).first()
    if rows.length > 1_000_000:
        raise ValueError("the manifest is larger than 1 MB")
    return json.loads(bytes(rows.content).decode("utf-8"))


def unpacked_digest(spark: SparkSession, path: str, most: int) -> tuple[int, str, int]:
    """Size, SHA-256 and number of header columns of a (gzip) file's content, unpacked piece by piece in a task up to ``most`` bytes."""

    def run(batches):
        for batch in batches:
            sizes, hashes, columns = [], [], []
            for content in batch["content"]:
                packed = io.BytesIO(content)
                stream = gzip.GzipFile(fileobj=packed) if bytes(content[:2]) == b"\x1f\x8b" else packed
                h, n, head = hashlib.sha256(), 0, b""
                while n <= most and (piece := stream.read(1 << 16)):
                    h.update(piece)
                    n += len(piece)
                    head = head + piece if b"\n" not in head else head
                sizes.append(n)
                hashes.append(h.hexdigest())
                columns.append(head.split(b"\n", 1)[0].count(b",") + 1)
            yield pd.DataFrame({"n": sizes, "sha": hashes, "columns": columns})

    r = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "n long, sha string, columns int").first()
    if r.n > most:
        raise ValueError(f"the snapshot unpacks to more than {most} bytes")
    return int(r.n), r.sha, int(r.columns)


#: Keys of a snapshot's manifest and its unit (fixed values: manifests in use must load).
MANIFEST = ("compressed_bytes", "compressed_sha256", "uncompressed_bytes", "uncompressed_sha256", "rows_excluding_header", "columns", "first_date", "last_date", "units", "series_ids")
UNITS, CREATED = "percent_per_annum", "snapshot_created_at_utc"


def resolve_snapshot(config: DataConfig, root: str | None = None, package: str = "panelfactor.resources") -> tuple[str, str]:
    """Paths of the snapshot and its manifest: those of the settings (from ``root`` on), or the ones that ``package`` brings.

    The package stands in only if the files are absent and both settings are the defaults.
    """
    at = lambda path: os.path.join(root, path) if root else path
    told = (at(config.snapshot_path), at(config.manifest_path))
    if all("://" in p or os.path.isfile(p) for p in told):
        return told
    default = DataConfig()
    if (config.snapshot_path, config.manifest_path) == (default.snapshot_path, default.manifest_path):
        try:
            inside = [str(importlib.resources.files(package).joinpath(os.path.basename(p))) for p in told]
        except ModuleNotFoundError:
            inside = []
        if inside and all(map(os.path.isfile, inside)):
            return inside[0], inside[1]
    raise FileNotFoundError(f"the snapshot or its manifest is missing: {told[0]}, {told[1]}")


def read_snapshot(spark: SparkSession, path: str, manifest_path: str, nodes: Nodes, config: DataConfig) -> tuple[DataFrame, Provenance]:
    """A frozen CSV whose size, hash, unpacked content, rows, dates, units, series and creation time match its manifest."""
    m = read_manifest(spark, manifest_path)
    if absent := [k for k in MANIFEST if k not in m]:
        raise ValueError(f"the manifest lacks {absent}")
    created = m.get(CREATED)
    if m["units"] != UNITS or tuple(m["series_ids"]) != nodes.series_ids or m["columns"] != len(nodes.names) + 1 or (created is not None and datetime.fromisoformat(created).tzinfo is None):
        raise ValueError("the manifest describes another series")
    size, sha = file_digest(spark, path)
    if size > config.maximum_response_bytes or size != m["compressed_bytes"] or sha != m["compressed_sha256"]:
        raise ValueError("the snapshot's bytes don't match its manifest")
    if unpacked_digest(spark, path, config.maximum_response_bytes) != (m["uncompressed_bytes"], m["uncompressed_sha256"], m["columns"]):
        raise ValueError("the snapshot's content doesn't match its manifest")
    raw = spark.read.option("header", True).csv(path)
    everything, defects = panel.parse_panel(raw, nodes, "0001-01-01", "9999-12-31")
    panel.refuse_defects(defects)
    n, first, last = everything.agg(F.count("*"), F.min(DATE), F.max(DATE)).first()
    if (n, str(first), str(last)) != (m["rows_excluding_header"], m["first_date"], m["last_date"]):
        raise ValueError("the snapshot's rows don't match its manifest")
    typed = everything.where(F.col(DATE).between(config.start_date, config.end_date))
    return typed, Provenance("SNAPSHOT", path, sha, created or "", n, str(first), str(last))


def query_identity(config: DataConfig, nodes: Nodes) -> str:
    """Sixteen hex digits that tell a range of a set of series apart."""
    return hashlib.sha256(json.dumps([config.start_date, config.end_date, nodes.series_ids]).encode()).hexdigest()[:16]


def fetch_live(spark: SparkSession, fetch, config: DataConfig, nodes: Nodes, base: str, sleep=time.sleep) -> bytes:
    """The live panel through the ``panel_live`` data source, as one payload of at most ``maximum_response_bytes``.

    Workers ask for its ranges of dates; rows come together here, in order of date, since the cache keeps them as one file.
    """
    spark.dataSource.register(live_source(fetch, sleep))
    options = {"ids": ",".join(nodes.series_ids), "start": config.start_date, "end": config.end_date, "base": base, "timeout": config.request_timeout_seconds, "retries": config.retries, "maximum_bytes": config.maximum_response_bytes}
    rows = spark.read.format("panel_live").options(**{k: str(v) for k, v in options.items()}).load()
    try:
        lines = [",".join(x or "" for x in r) for r in rows.orderBy("observation_date").toLocalIterator()]
    except PySparkException as e:
        told = str(e)
        for word, kind in ((UNAVAILABLE, SourceUnavailable), (INVALID, PayloadInvalid)):
            if word in told:
                raise kind(told[told.index(word) :].splitlines()[0]) from e
        raise
    payload = "\n".join([",".join(rows.columns), *lines, ""]).encode()
    if len(payload) > config.maximum_response_bytes or not lines:
        raise PayloadInvalid(f"{INVALID}: no rows" if not lines else f"{INVALID}: larger than allowed")
    return payload


@contextlib.contextmanager
def locked(folder: str, key: str, patience: float = 5.0):
    """An exclusive lock of a cache entry; TimeoutError (an OSError) if another holds it for ``patience`` seconds."""
    import fcntl

    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{key}.lock"), "ab") as f:
        end = time.monotonic() + patience
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() > end:
                    raise TimeoutError(f"the cache entry {key} is in use") from None
                time.sleep(0.05)
        yield


def write_cache(folder: str, key: str, payload: bytes, acquired_at: str) -> None:
    """Payload and sidecar under the entry's lock, each written beside and then renamed, the sidecar last."""
    with locked(folder, key):
        _write_cache(folder, key, payload, acquired_at)


def _write_cache(folder: str, key: str, payload: bytes, acquired_at: str) -> None:
    side = json.dumps({"schema": 2, "key": key, "bytes": len(payload), "sha256": hashlib.sha256(payload).hexdigest(), "acquired_at": acquired_at}, sort_keys=True).encode()
    for name, data in ((f"{key}.csv", payload), (f"{key}.json", side)):
        at = os.path.join(folder, name)
        with open(f"{at}.{os.getpid()}.tmp", "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f.name, at)


def read_cache(folder: str, key: str, config: DataConfig, now: datetime) -> tuple[str, str] | None:
    """(path, acquired_at) of a cached payload that is whole, of this query and young enough; None on any defect."""
    try:
        with open(os.path.join(folder, f"{key}.json"), "rb") as f:
            side = json.loads(f.read(100_000))
        with open(os.path.join(folder, f"{key}.csv"), "rb") as f:
            payload = f.read(config.maximum_response_bytes + 1)
        age = (now - datetime.fromisoformat(side["acquired_at"])).total_seconds() / 3600
        whole = side["schema"] == 2 and side["key"] == key and side["bytes"] == len(payload) and side["sha256"] == hashlib.sha256(payload).hexdigest()
        return (os.path.join(folder, f"{key}.csv"), side["acquired_at"]) if whole and 0 <= age <= config.cache_max_age_hours else None
    except (OSError, ValueError, KeyError, TypeError):
        return None


def _parsed(spark: SparkSession, payload: bytes, nodes: Nodes, config: DataConfig) -> DataFrame:
    """The typed panel of a payload; PayloadInvalid if it is none."""
    lines = payload.decode("utf-8-sig").splitlines()
    header, body = lines[0].split(","), [x.split(",") for x in lines[1:] if x]
    if any(len(x) != len(header) for x in body) or not body:
        raise PayloadInvalid("the payload's rows differ in length")
    raw = spark.createDataFrame([tuple(x) for x in body], ", ".join(f"`{c}` string" for c in header))
    try:
        typed, defects = panel.parse_panel(raw, nodes, config.start_date, config.end_date)
        panel.refuse_defects(defects)
    except ValueError as e:
        raise PayloadInvalid(str(e)) from e
    return typed


def passes_quality(daily: DataFrame, nodes: Nodes, config: DataConfig, as_of: str) -> bool:
    """Whether a panel, as it is now, passes every quality check that can fail."""
    core = nodes.subset(config.core_tenors).names
    weekly = panel.weekly_curve(daily, core, config.anchor, config.boundary_week_policy, config.start_date, config.end_date)
    metrics = quality.quality_metrics(daily, weekly, panel.changes(weekly, core), nodes, core, config.anchor, config.boundary_week_policy, config.start_date, config.end_date)
    checks = quality.quality_checks(metrics, config, "LOCAL_CACHE", as_of)
    return checks.limit(1).count() > 0 and not checks.where("status = 'FAIL'").limit(1).count()


def read_live(spark: SparkSession, config: DataConfig, nodes: Nodes, fetch, folder: str, base: str = BASE, now: datetime | None = None, sleep=time.sleep, as_of: str | None = None) -> tuple[DataFrame, Provenance]:
    """The panel of a live source (:mod:`.live`) through its cache folder, a local one of the driver.

    A cached payload counts only if it is whole, of this query, young enough, parses, and passes the quality checks of ``as_of``
    (none: today); any defect is a miss.
    """
    now = now or datetime.now(timezone.utc)
    key = query_identity(config, nodes)
    cached = read_cache(folder, key, config, now) if config.use_cache else None
    typed = None
    if cached:
        mode, (path, acquired) = "LOCAL_CACHE", cached
        with open(path, "rb") as f:
            payload = f.read()
        try:
            typed = _parsed(spark, payload, nodes, config)
            typed = typed if passes_quality(typed, nodes, config, as_of or now.date().isoformat()) else None
        except (PayloadInvalid, UnicodeDecodeError):
            typed = None
    if typed is None:
        payload, acquired = fetch_live(spark, fetch, config, nodes, base, sleep), now.isoformat()
        typed = _parsed(spark, payload, nodes, config)
        mode = "LIVE_FRED"
        try:
            write_cache(folder, key, payload, acquired)
        except OSError:
            mode = "LIVE_FRED_NO_CACHE"
    n, first, last = typed.agg(F.count("*"), F.min(DATE), F.max(DATE)).first()
    return typed, Provenance(mode, base, hashlib.sha256(payload).hexdigest(), acquired, n, str(first), str(last))


def read_source(spark: SparkSession, config: DataConfig, nodes: Nodes, snapshot: tuple[str, str] | None = None, fetch=None, folder: str = "cache", **live) -> tuple[DataFrame, Provenance]:
    """The configured source; a snapshot stands in for a live source only if that can't be reached.

    ``snapshot``: file and manifest in place of the settings' (:func:`resolve_snapshot`).
    """
    if config.source_mode == "snapshot":
        return read_snapshot(spark, *(snapshot or resolve_snapshot(config)), nodes, config)
    try:
        return read_live(spark, config, nodes, fetch, folder, **live)
    except SourceUnavailable as e:
        if config.source_mode == "live":
            raise
        rows, p = read_snapshot(spark, *(snapshot or resolve_snapshot(config)), nodes, config)
        return rows, Provenance("SNAPSHOT_FALLBACK", p.location, p.sha256, p.acquired_at, p.rows, p.first_date, p.last_date, str(e))


def canonical_digest(daily: DataFrame, nodes: Nodes) -> DataFrame:
    """Rows and a SHA-256 of each panel's content: its row hashes (date and values to eight places) in date order.

    Row hashes are made in parallel; one 64-character string for each day is gathered for each panel.
    """
    text = F.concat_ws(",", F.col(DATE).cast("string"), *(F.coalesce(F.format_string("%.8f", F.col(f"`{n}`")), F.lit("")) for n in nodes.names))
    rows = daily.select(PANEL, DATE, F.sha2(text, 256).alias("h"))
    lists = rows.groupBy(PANEL).agg(F.count("*").alias("n_days"), F.array_sort(F.collect_list(F.struct(DATE, "h"))).alias("x"))
    return lists.select(PANEL, "n_days", F.sha2(F.array_join(F.col("x.h"), ""), 256).alias("content_sha256"))
