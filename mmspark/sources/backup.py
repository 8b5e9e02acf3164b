"""Point-in-time copies of tables with a manifest."""

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "MANIFEST.json"


@dataclass(frozen=True)
class Manifest:
    backupId: str
    timestamp: str
    version: str = "1"
    sequenceNumber: int = 0
    collections: list[str] = field(default_factory=list)
    path: str = ""
    isConsistent: bool = True
    label: str = ""

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "Manifest":
        given = json.loads(text)
        if not given.get("backupId") or not given.get("timestamp"):
            raise ValueError("a manifest needs backupId and timestamp")
        return cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__})


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def create(spark: SparkSession, base: str, tables: dict[str, DataFrame], sequence: int = 0, label: str = "", now: datetime | None = None) -> Manifest:
    """Write every table, then the manifest; a failure removes the folder."""
    now = now or datetime.now(timezone.utc)
    name = now.strftime("%Y-%m-%dT%H.%M.%S.%f")
    folder = f"{base}/{name}"
    try:
        for table, df in tables.items():
            df.write.parquet(f"{folder}/{table}.parquet")
        done = Manifest(name, now.strftime("%Y-%m-%dT%H:%M:%SZ"), sequenceNumber=sequence, collections=sorted(tables), path=folder, label=label)
        fs, p = _fs(spark, f"{folder}/{MANIFEST}")
        out = fs.create(p, False)
        out.write(bytearray(done.to_json().encode()))
        out.close()
        return done
    except Exception:
        delete(spark, base, name)
        raise


def read_manifest(spark: SparkSession, base: str, name: str) -> Manifest:
    fs, p = _fs(spark, f"{base}/{name}/{MANIFEST}")
    if not fs.exists(p):
        raise FileNotFoundError(f"no manifest of {name}")
    return Manifest.from_json("\n".join(r[0] for r in spark.read.text(f"{base}/{name}/{MANIFEST}").collect()))


def listing(spark: SparkSession, base: str) -> DataFrame:
    """The valid manifests by time."""
    schema = "backupId string, timestamp string, version string, sequenceNumber long, collections array<string>, path string, isConsistent boolean, label string"
    return spark.read.schema(schema).json(f"{base}/*/{MANIFEST}").where("backupId is not null and timestamp is not null").orderBy("timestamp", "backupId")


def delete(spark: SparkSession, base: str, name: str) -> bool:
    fs, p = _fs(spark, f"{base}/{name}")
    return bool(fs.exists(p) and fs.delete(p, True))


def validate(spark: SparkSession, base: str, name: str) -> tuple[int, str]:
    """404 without the backup, 400 without manifest or data, else 200."""
    fs, p = _fs(spark, f"{base}/{name}")
    if not fs.exists(p):
        return 404, "backup not found"
    try:
        found = read_manifest(spark, base, name)
    except (FileNotFoundError, ValueError) as e:
        return 400, str(e)
    missing = [t for t in found.collections if not fs.exists(_fs(spark, f"{base}/{name}/{t}.parquet")[1])]
    return (400, f"no data of {', '.join(missing)}") if missing or not found.collections else (200, "ok")


def restore(spark: SparkSession, base: str, name: str) -> dict[str, DataFrame]:
    code, why = validate(spark, base, name)
    if code != 200:
        raise ValueError(f"{code}: {why}")
    return {t: spark.read.parquet(f"{base}/{name}/{t}.parquet") for t in read_manifest(spark, base, name).collections}


def prune(spark: SparkSession, base: str, keep: int) -> list[str]:
    """Delete the oldest backups beyond the newest `keep`."""
    names = [r["backupId"] for r in listing(spark, base).select("backupId").collect()]
    old = names[: max(0, len(names) - keep)]
    for name in old:
        delete(spark, base, name)
    return old


class Service:
    """Create, list, delete and restore as a service answers: an envelope of error, code and result."""

    OPERATIONS = ("create", "list", "delete", "restore")

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    @staticmethod
    def _done(result) -> dict:
        return {"error": False, "code": 200, "result": result}

    @staticmethod
    def _failed(code: int, message: str) -> dict:
        return {"error": True, "code": code, "errorMessage": message}

    @staticmethod
    def _entry(m) -> dict:
        return {"id": m["backupId"], "datetime": m["timestamp"], "version": m["version"], "collections": list(m["collections"] or []), "isConsistent": m["isConsistent"]}

    def run(self, operation: str, **given) -> dict:
        return getattr(self, operation)(**given) if operation in self.OPERATIONS else self._failed(404, f"unknown operation: {operation}")

    def create(self, tables: dict[str, DataFrame], label: str = "", sequence: int = 0) -> dict:
        began = datetime.now(timezone.utc)
        try:
            done = create(self.spark, self.base, tables, sequence, label)
        except Exception as e:  # noqa: BLE001 - the answer says what failed
            return self._failed(500, str(e).splitlines()[0])
        return self._done(self._entry(asdict(done)) | {"durationSeconds": (datetime.now(timezone.utc) - began).total_seconds()})

    def list(self) -> dict:
        fs, p = _fs(self.spark, self.base)
        return self._done([self._entry(m.asDict()) for m in listing(self.spark, self.base).collect()] if fs.exists(p) and fs.listStatus(p) else [])

    def delete(self, name: str) -> dict:
        return self._done({"deleted": True, "id": name}) if delete(self.spark, self.base, name) else self._failed(404, f"Backup not found: {name}")

    def restore(self, name: str) -> dict:
        code, why = validate(self.spark, self.base, name)
        return self._done({"restored": True, "id": name}) if code == 200 else self._failed(code, why)
