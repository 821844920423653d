"""Named tables of the engine, and stand-ins for them made from the test tables.

The stand-ins are written as portable SQL, so that queries and their oracles start from equal rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_TAGS = ["sunset", "beach", "sunset-beach", "portrait", "city", "night", "forest", "product", "people", "winter", "macro", "logo"]
_BRANDS = ["Nikon", "Nik", "Canon", "Acme"]


def _pick(n: str, values: list[str]) -> str:
    return f"CASE ({n}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _dec(expr: str, p: int, s: int) -> str:
    return f"CAST(({expr}) AS DECIMAL({p},{s}))"


def _ts(base: str, seconds: str, dialect: str) -> str:
    if dialect == "spark":
        return f"timestampadd(SECOND, CAST({seconds} AS INT), TIMESTAMP '{base}')"
    return f"(TIMESTAMP '{base}' + to_seconds(CAST({seconds} AS INT)))"


def standin_sql(dialect: str) -> dict[str, str]:
    """SQL of every stand-in table over the test tables; `dialect` is spark or duckdb."""
    arr = (lambda *x: f"array({', '.join(x)})") if dialect == "spark" else (lambda *x: f"[{', '.join(x)}]")
    struct = (lambda **k: "named_struct(" + ", ".join(f"'{a}', {b}" for a, b in k.items()) + ")") if dialect == "spark" else (lambda **k: "{" + ", ".join(f"'{a}': {b}" for a, b in k.items()) + "}")
    big = "BIGINT"
    assets = f"""
        SELECT doc_id AS id, CAST(substr(source, 4) AS {big}) AS volumeId,
               concat(CASE WHEN doc_id % 5 = 0 THEN 'holiday-photo' ELSE 'IMG' END, '_', CAST(doc_id AS VARCHAR(20)), {_pick("doc_id", [".jpg", ".png", ".webp", ".tiff", ".svg", ".bmp", ".heic"])}) AS filename,
               {_pick("doc_id", ["image/jpeg", "image/png", "image/webp", "image/tiff", "image/svg+xml", "image/bmp", "image/heic"])} AS mimeType,
               CASE WHEN doc_id % 11 = 0 THEN 'document' ELSE 'image' END AS kind,
               CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE substr(text, 1, 40) END AS alt,
               CAST(300 + (doc_id * 53) % 5200 AS INT) AS width, CAST(200 + (doc_id * 37) % 3000 AS INT) AS height,
               n_chars * 1000 + doc_id % 1000 AS size,
               CASE WHEN doc_id % 3 = 0 THEN '0.5;0.5' END AS focalPoint,
               CASE WHEN doc_id % 6 = 0 THEN concat('IMG_', CAST(doc_id AS VARCHAR(20))) WHEN doc_id % 6 = 1 THEN '' WHEN doc_id % 5 = 0 THEN concat('Holiday photo ', CAST(doc_id AS VARCHAR(20))) ELSE substr(text, 1, 24) END AS title,
               lang AS language, {_ts("2024-01-01 00:00:00", "(doc_id % 10000) * 977", dialect)} AS dateCreated,
               CASE WHEN doc_id % 97 = 0 THEN {_ts("2024-06-01 00:00:00", "doc_id % 1000", dialect)} END AS dateDeleted
        FROM documents"""
    analyses = f"""
        SELECT l.doc_id + 1000000 AS id, l.doc_id AS assetId,
               {_pick("l.doc_id % 10", ["pending", "failed", "processing", "completed", "completed", "completed", "completed", "completed", "completed", "completed"])} AS status,
               CASE WHEN l.doc_id % 20 = 2 THEN 'completed' END AS previousStatus,
               {_pick("l.doc_id", ["openai", "gemini", "claude", "openai"])} AS provider,
               CASE WHEN l.doc_id % 9 = 0 THEN NULL ELSE {_pick("l.doc_id", ["gpt-5.4", "gemini-2.5-flash", "claude-opus-4-6", "gpt-5.4-mini"])} END AS providerModel,
               CASE WHEN l.doc_id % 8 = 0 THEN 'edited by hand' ELSE substr(d.text, 1, 60) END AS altText, substr(d.text, 1, 60) AS altTextAi,
               CASE WHEN l.doc_id % 13 = 0 THEN NULL ELSE {_dec("(l.doc_id * 7) % 101 / 100.0", 3, 2)} END AS altTextConfidence,
               substr(d.text, 1, 24) AS suggestedTitle, CASE WHEN l.doc_id % 7 = 0 THEN 'another title' ELSE substr(d.text, 1, 24) END AS suggestedTitleAi,
               substr(d.text, 1, 300) AS longDescription, substr(d.text, 1, 300) AS longDescriptionAi,
               CAST(CASE WHEN l.doc_id % 3 = 0 THEN 0 ELSE l.doc_id % 9 END AS INT) AS faceCount, l.doc_id % 3 <> 0 AS containsPeople,
               CASE WHEN l.doc_id % 17 = 0 THEN NULL ELSE {_dec("(l.doc_id * 31) % 10001 / 10000.0", 5, 4)} END AS nsfwScore,
               l.toxic = 1 OR l.doc_id % 5 = 0 AS hasWatermark,
               CASE WHEN l.toxic = 1 OR l.doc_id % 5 = 0 THEN {_pick("l.doc_id", ["stock", "logo", "text", "unknown"])} END AS watermarkType,
               CASE WHEN l.doc_id % 4 = 0 THEN {struct(stockProvider=_pick("(l.doc_id - l.doc_id % 4) % 12", ["Shutterstock", "", "", "", "getty images", "", "", "", "iStock photo", "", "", ""]))} END AS watermarkDetails,
               l.doc_id % 4 < 2 AS containsBrandLogo,
               CASE WHEN l.doc_id % 4 = 0 THEN {arr(struct(brand=f"'{_BRANDS[0]}'", confidence="CAST(0.9 AS DOUBLE)"), struct(brand=f"'{_BRANDS[2]}'", confidence="CAST(0.4 AS DOUBLE)"))}
                    WHEN l.doc_id % 4 = 1 THEN {arr(struct(brand=f"'{_BRANDS[1]}'", confidence="CAST(0.5 AS DOUBLE)"))} END AS detectedBrands,
               CASE WHEN l.doc_id % 19 = 0 THEN NULL ELSE {_dec("(l.doc_id * 17) % 101 / 100.0", 5, 4)} END AS sharpnessScore,
               CASE WHEN l.doc_id % 23 = 0 THEN NULL ELSE {_dec("(l.doc_id * 29) % 101 / 100.0", 5, 4)} END AS exposureScore,
               {_dec("(l.doc_id * 11) % 101 / 100.0", 5, 4)} AS shadowClipRatio, {_dec("(l.doc_id * 13) % 101 / 100.0", 5, 4)} AS highlightClipRatio,
               {_dec("(l.doc_id * 41) % 101 / 100.0", 5, 4)} AS noiseScore, CAST((l.doc_id * 3) % 101 AS INT) AS compressionQuality,
               {_pick("l.doc_id", ["srgb", "cmyk", "adobe-rgb", "grayscale"])} AS colorProfile,
               CASE WHEN l.doc_id % 3 = 0 THEN NULL WHEN l.doc_id % 3 = 1 THEN {arr("'Invoice #123'", "'Total: $50'")} ELSE {arr("'hello world'")} END AS extractedTextAi,
               CAST(2000 + (l.doc_id * 7) % 1999 AS INT) AS inputTokens, CAST(900 + (l.doc_id * 5) % 401 AS INT) AS outputTokens,
               {_dec("(l.doc_id * 7919) % 50000 / 1000000.0", 10, 6)} AS actualCost,
               CASE WHEN l.doc_id % 10 <> 0 THEN {_ts("2024-01-01 00:00:00", "(l.doc_id % 10000) * 1399", dialect)} END AS processedAt,
               {_ts("2024-01-02 00:00:00", "(l.doc_id % 10000) * 1409", dialect)} AS dateUpdated
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""
    one_tag = lambda k: f"SELECT doc_id AS assetId, doc_id + 1000000 AS analysisId, {_pick(f'doc_id * {k + 3} + {k}', [t.title() for t in _TAGS])} AS tag, {_pick(f'doc_id * {k + 3} + {k}', _TAGS)} AS tagNormalized, {_dec(f'(doc_id * {7 + k}) % 101 / 100.0', 5, 4)} AS confidence, doc_id % 6 <> {k} AS isAi FROM labels"
    pairs = f"""
        SELECT doc_id * 10 AS id, doc_id AS canonicalAssetId, doc_id + 2 + doc_id % 3 AS duplicateAssetId, CAST(doc_id % 11 AS INT) AS hammingDistance,
               {_dec("1 - (doc_id % 11) / 256.0", 5, 4)} AS similarity, CASE WHEN doc_id % 5 = 0 THEN 'ignored' WHEN doc_id % 10 = 3 THEN 'kept' END AS resolution
        FROM documents WHERE doc_id % 4 < 2"""
    logs = f"""
        SELECT event_id AS id, {_pick("event_id", ["info", "warning", "error", "info", "critical"])} AS level,
               {_pick("event_id * 3", ["api_request", "job_failed", "asset_processing"])} AS category, event_type AS message, user_id AS assetId, props AS context, ts AS dateCreated
        FROM events"""
    errors = f"""
        SELECT doc_id + 1000000 AS analysisId, concat('message ', CAST(doc_id % 7 AS VARCHAR(9))) AS errorMessage,
               CASE WHEN doc_id % 40 = 1 THEN NULL WHEN doc_id % 40 = 11 THEN 'no such code' ELSE {_pick("doc_id", ["rate_limit", "timeout", "invalid_response"])} END AS errorCode
        FROM labels WHERE doc_id % 10 = 1"""
    return {"assets": assets, "analyses": analyses, "asset_tags": " UNION ALL ".join(one_tag(k) for k in range(4)), "duplicate_groups": pairs, "logs": logs, "analysis_content": errors}


@dataclass(frozen=True)
class Catalog:
    """The engine's tables. Any of them may be a table of the installation or a stand-in."""

    spark: SparkSession
    tables: Mapping[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise AttributeError(name) from None

    def register(self, prefix: str = "") -> None:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(prefix + name)


def open_catalog(spark: SparkSession, folder: str) -> Catalog:
    """Tables of an installation: one Parquet folder each, of the last version that was written as a whole."""
    from .schemas import _DDL, schema

    _, places = current_version(spark, folder)
    return Catalog(spark, {n: table_at(spark, folder, schema(n), places.get(n, n + ".parquet")) for n in _DDL})


def paths_of(place: Place) -> list[str]:
    """Paths of a table below the folder: its own, or those of all its parts."""
    return [place] if isinstance(place, str) else [p for parts in place.values() for p in parts]


def table_at(spark: SparkSession, folder: str, columns: StructType, place: Place) -> DataFrame:
    paths = paths_of(place)
    return spark.read.schema(columns).parquet(*(f"{folder}/{p}" for p in paths)) if paths else spark.createDataFrame([], columns)


#: Where a table lies: one path, or paths by the name of a part, such as a day.
Place = str | dict[str, list[str]]

#: Seconds after which the claim of a writer that hasn't come to its end no longer holds.
LEASE = 900


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _named(fs, path, folder: str, pattern: str) -> list[str]:
    return [s.getPath().getName() for s in fs.globStatus(path(f"{folder}/{pattern}")) or []]


def _number(name: str) -> int:
    return int(name.split(".")[0].split("-")[1])


def current_version(spark: SparkSession, folder: str) -> tuple[int, dict[str, Place]]:
    """Number of the last complete version, and where each of its tables lies below `folder`; 0 and none before the first."""
    fs, path = _file_system(spark, folder)
    known = sorted(map(_number, _named(fs, path, folder, "version-*.json")))
    return (known[-1], _places(spark, folder, known[-1])) if known else (0, {})


def _places(spark: SparkSession, folder: str, version: int) -> dict[str, Place]:
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/version-{version}.json").collect()))["tables"]  # a line


def _file_time(fs, path, folder: str) -> int:
    """Now, in milliseconds of the file system's clock."""
    probe = path(f"{folder}/.now-{uuid.uuid4().hex}")
    fs.create(probe, True).close()
    try:
        return fs.getFileStatus(probe).getModificationTime()
    finally:
        fs.delete(probe, False)


def _claim(fs, path, folder: str, version: int, lease: float) -> bool:
    """Whether this writer may write a version: nobody has claimed it, or whoever has let the lease pass. Of two that find a lease has passed one moves the old claim away."""
    claim = path(f"{folder}/claim-{version}")
    if fs.createNewFile(claim):
        return True
    try:
        if _file_time(fs, path, folder) - fs.getFileStatus(claim).getModificationTime() < lease * 1000:
            return False
        moved = fs.rename(claim, path(f"{folder}/.left-{version}-{uuid.uuid4().hex}"))
    except Exception as e:  # the claim went meanwhile
        if "FileNotFound" not in str(e):
            raise
        moved = True
    return moved and fs.createNewFile(claim)


def _move(spark: SparkSession, fs, source, target) -> bool:
    """Moves a file to a name that must be free; false if it isn't."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(source, target, none)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def write_version(tables: Mapping[str, DataFrame], folder: str, lease: float = LEASE, tries: int = 5) -> int:
    """Writes some tables as the next version: readers see all of them or none, and other tables stay as they are.

    Tables are written beside the old ones. Then the writer claims the next number, and puts the file that describes that version under a name that must be free: this
    is the fence, since of several writers of a number one succeeds, even if a claim has been taken over from one that was only slow. Where another writer came first, the
    version is made on top of its own if that has left these tables as they were; else this one fails, before any reader sees its tables. A writer
    that ends at any point blocks others for `lease` seconds at most. The file system must refuse to move a file onto another (object stores may not).
    """
    spark = next(iter(tables.values())).sparkSession
    fs, path = _file_system(spark, folder)
    began, places = current_version(spark, folder)
    before = {name: places.get(name) for name in tables}
    own = {name: f"version={began + 1}-{uuid.uuid4().hex[:8]}/{name}.parquet" for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{own[name]}")

    def placed(version: int, places: dict[str, Place]) -> dict[str, Place]:
        if {name: places.get(name) for name in tables} != before:
            raise RuntimeError(f"another writer has written version {version} of {folder} with tables of this one")
        return places | own

    return commit(spark, folder, placed, list(own.values()), lease, tries)


def commit(spark: SparkSession, folder: str, edit: Callable[[int, dict[str, Place]], dict[str, Place]], own: list[str], lease: float = LEASE, tries: int = 5) -> int:
    """Makes the next version from what `edit` gives for the current one and its number, with paths `own` that this writer has written. Where another writer comes first,
    `edit` is asked again, on top of that one's version; it raises if that stands in its way."""
    fs, path = _file_system(spark, folder)
    for _ in range(tries):
        now, places = current_version(spark, folder)
        after = edit(now, places)
        version = now + 1
        if not _claim(fs, path, folder, version, lease):
            if current_version(spark, folder)[0] > now:
                continue
            raise RuntimeError(f"another writer has claimed version {version} of {folder}")
        if not all(fs.exists(path(f"{folder}/{p}")) for p in own):
            raise RuntimeError(f"tables of version {version} of {folder} were removed while they were written")
        new = path(f"{folder}/writing-{version}-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(json.dumps({"version": version, "tables": after}).encode())
        out.close()
        done = _move(spark, fs, new, path(f"{folder}/version-{version}.json"))
        if done:
            return version
        fs.delete(new, False)
    raise RuntimeError(f"other writers came first {tries} times in {folder}")


def pin(spark: SparkSession, folder: str, seconds: float = 3600) -> tuple[Catalog, str]:
    """The current version for a reader, whose tables stay for that time, and the name of the pin, which `unpin` removes."""
    from .schemas import _DDL, schema

    fs, path = _file_system(spark, folder)
    while True:
        version, places = current_version(spark, folder)
        name = f"pin-{version}-{_file_time(fs, path, folder) + int(seconds * 1000)}-{uuid.uuid4().hex}"
        fs.create(path(f"{folder}/{name}"), True).close()
        if not version or fs.exists(path(f"{folder}/version-{version}.json")):  # else removed before the pin was there
            return Catalog(spark, {n: table_at(spark, folder, schema(n), p) for n, p in places.items() if n in _DDL}), name
        unpin(spark, folder, name)


def unpin(spark: SparkSession, folder: str, name: str) -> None:
    fs, path = _file_system(spark, folder)
    fs.delete(path(f"{folder}/{name}"), False)


def remove_old_versions(spark: SparkSession, folder: str, lease: float = LEASE) -> None:
    """Deletes versions but for the current one and those that readers have pinned, tables that none of these names, and claims and pins whose time has passed.

    Tables of a number that isn't written yet may be another writer's work, and stay. A writer that began before the current version and is still at work fails if its tables go.
    """
    fs, path = _file_system(spark, folder)
    version, places = current_version(spark, folder)
    now = _file_time(fs, path, folder)
    pinned = set()
    for name in _named(fs, path, folder, "pin-*"):
        if int(name.split("-")[2]) > now:
            pinned.add(_number(name))
        else:
            unpin(spark, folder, name)
    used = {path for place in places.values() for path in paths_of(place)}
    for name in _named(fs, path, folder, "version-*.json"):
        n = _number(name)
        if n in pinned:
            used |= {path for place in _places(spark, folder, n).values() for path in paths_of(place)}
        elif n != version:
            fs.delete(path(f"{folder}/{name}"), False)
    tops = {p.split("/")[0] for p in used}
    for status in fs.globStatus(path(f"{folder}/version=*/*/day=*")) or []:  # days that were dropped
        part = "/".join(status.getPath().toString().split("/")[-3:])
        if part.split("/")[0] in tops and part not in used and "/".join(part.split("/")[:2]) not in used and int(part[8:].split("-")[0]) <= version:
            fs.delete(status.getPath(), True)
    for status in fs.listStatus(path(folder)):
        name = status.getPath().getName()
        old = now - status.getModificationTime() >= lease * 1000
        if name.startswith("version=") and name not in tops and int(name[8:].split("-")[0]) <= version:
            fs.delete(status.getPath(), True)
        elif name.startswith("claim-") and (_number(name) <= version or old):
            fs.delete(status.getPath(), False)
        elif name.startswith((".left-", "writing-")) and old:
            fs.delete(status.getPath(), False)


class _Standins(Mapping):
    """Makes a table when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.sql, self.made = spark, sf_dir, standin_sql("spark"), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            sql, base = self.sql[name], {}
            for n in ("documents", "labels", "events"):
                if f"FROM {n}" in sql or f"JOIN {n}" in sql:
                    base[n] = self.spark.read.parquet(f"{self.sf_dir}/{n}.parquet")
                    sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
            self.made[name] = self.spark.sql(sql, **base)
        return self.made[name]

    def __iter__(self):
        return iter(self.sql)

    def __len__(self) -> int:
        return len(self.sql)


def test_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Stand-ins over the test tables in `sf_dir`."""
    return Catalog(spark, _Standins(spark, sf_dir))


def with_standins(sql: str) -> str:
    """DuckDB SQL that may use the stand-ins as tables."""
    made = standin_sql("duckdb")
    used = [n for n in made if n in sql]
    ctes = ",\n".join(f"{n} AS ({made[n]})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"


def size_is_known_small(df: DataFrame, most: int) -> bool:
    """Whether a table has at most `most` rows, found without counting further."""
    return df.select(F.lit(1)).limit(most + 1).count() <= most
