"""A store of documents: upserts, generations, fingerprints, redaction and session events."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.functions.ordered import numbered

# Prefixes of credentials.
CREDENTIALS = ["sk-", "sk_live_", "rk_live_", "xox", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "AKIA", "ASIA", "AIza", "ya29.", "hf_", "npm_"]
# Markers of lines that hold secrets.
SECRET_MARKERS = ["api_key", "apikey", "api key", "access_token", "access token", "authorization:", "bearer ", "password=", "password:", "token=", "token:"]
# Kinds of session events.
EVENT_KINDS = {
    "SessionStart": "session_start", "UserPromptSubmit": "user_prompt", "UserPromptExpansion": "user_prompt", "PreToolUse": "tool_call", "PostToolUse": "tool_result",
    "PostToolUseFailure": "tool_error", "PreCompact": "compaction", "PostCompact": "compaction", "SubagentStart": "subagent_start", "SubagentStop": "subagent_stop",
    "Stop": "assistant_message", "TurnUsage": "turn_usage", "SessionEnd": "session_end",
}


def upsert(old: DataFrame, new: DataFrame, key: str, at: str, removed: DataFrame | None = None) -> DataFrame:
    """The latest row of each key of both tables, without the removed keys; one aggregation, no window.

    A row without a time is earlier than any other; at the same time the new table
    wins, and within a table the row of the largest hash, so the result is one.
    """
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    hashed = [f.name for f in old.schema.fields if "map<" not in f.dataType.simpleString()]
    order = F.struct(F.col(at).isNotNull().alias("timed"), F.col(at).alias("at"), F.col("_new").alias("new"), F.xxhash64(*hashed).alias("tie"))
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
    return latest.join(removed.select(key).distinct(), key, "left_anti") if removed is not None else latest


def has_credentials(text: Column) -> Column:
    """Whether a text holds something that looks like a credential."""
    parts = F.split(text, r"[\s\"',;=:()\[\]{}<>]+")
    named = F.exists(parts, lambda t: t.rlike("^(?:" + "|".join(f"{p.replace('.', '[.]')}" for p in CREDENTIALS) + ").{8,}"))
    token = F.exists(parts, lambda t: (F.octet_length(t) >= 40) & t.rlike(r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"))
    return F.coalesce(F.contains(text, F.lit("-----BEGIN ")) | F.contains(text, F.lit("Bearer ")) | named | token, F.lit(False))


def redact_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Texts with secret lines replaced; lines from the begin to the end of a private key are secret."""
    lines = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    low = F.lower("line")
    begins = F.contains(low, F.lit("-----begin")) & F.contains(low, F.lit("private key"))
    ends = F.contains(low, F.lit("-----end")) & F.contains(low, F.lit("private key"))
    order = Window.partitionBy(key).orderBy("pos")
    state = F.last(F.when(ends, F.lit(0)).when(begins, F.lit(1)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = F.lit(False)
    for m in SECRET_MARKERS:
        marked = marked | F.contains(low, F.lit(m))
    secret = marked | begins | (F.coalesce(state, F.lit(0)) == 1) | has_credentials(F.col("line"))
    shown = lines.select(key, "pos", F.when(secret, "[REDACTED]").otherwise(F.col("line")).alias("line"), secret.cast("int").alias("secret"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return shown.groupBy(key).agg(joined.alias("redacted"), F.sum("secret").alias("secret_lines"))


def event_kind(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in EVENT_KINDS.items() for x in p]), name), F.lit("provider_event"))


def sequence_events(events: DataFrame, session: str = "session_id", order: list[str] | None = None) -> DataFrame:
    """Events with their number in the session, from 1; a session of any size is numbered across tasks."""
    return numbered(events, [session], order or ["received_at", "hook_id"], "sequence")


def interrupted(events: DataFrame, project: str, session: str, at: str, idle_minutes: int = 30) -> DataFrame:
    """Sessions that were idle for ``idle_minutes`` when another session of the project started."""
    spans = events.groupBy(project, session).agg(F.min(at).alias("started"), F.max(at).alias("last"))
    idle = F.expr(f"interval {idle_minutes} minutes")
    # A session can only be seen idle from the latest start of its project.
    latest = spans.groupBy(F.col(project).alias("_p")).agg(F.max("started").alias("_latest"))
    seen = spans.join(latest, F.col(project).eqNullSafe(F.col("_p"))).where(F.col("last") + idle <= F.col("_latest"))
    return seen.drop("_p", "_latest").withColumn("status", F.lit("interrupted"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One hash of (path, length, content hash) rows in path order; rows are hashed before they are gathered."""
    row = F.struct("path", F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), "content_hash"), 256).alias("h"))
    buckets = files.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("_b")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    part = buckets.select("_b", F.sha2(F.array_join(F.transform("r", lambda x: x["h"]), ""), 256).alias("h"))  # at most 4,096 rows
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))


class Store:
    """A keyed table under one folder of any Hadoop file system, in buckets by key.

    Each generation is a numbered manifest that names the folder of every bucket;
    readers take the highest number, so they never see half of a write.  A manifest
    is created exclusively: of two writers that start from the same generation one
    gets the next number, the other is told so and its files are removed.  An
    upsert reads and writes only the buckets that its keys fall into.
    """

    VERSION = 2

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifests"))

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def current(self) -> dict | None:
        """The latest manifest: version, generation, number, schema and the folder of each bucket."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("manifests")) if f.getPath().getName().endswith(".json")]
        if not names:
            return None
        stream = self._fs.open(self._path(f"manifests/{max(names)}"))
        try:
            state = json.loads(bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()
        if state["version"] != self.VERSION:
            raise ValueError(f"the store has version {state['version']}, not {self.VERSION}")
        return state

    def _claim(self, state: dict) -> bool:
        """Create the manifest of the state's number; false if another writer has."""
        try:
            stream = self._fs.create(self._path(f"manifests/{state['number']:012d}.json"), False)
        except Exception as e:  # noqa: BLE001
            if "exist" in str(e).lower():
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        return True

    def _table(self, state: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        folders = sorted({f for b, f in state["buckets"].items() if buckets is None or int(b) in buckets})
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        state = self.current()
        return self._table(state) if state else None

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, table: DataFrame, key: str | None, state: dict | None, replaced: set[int] | None) -> bool:
        name = f"gen-{uuid.uuid4().hex}"
        bucket = self._bucket(key) if key else F.lit(0)
        own = table.withColumn("_bucket", bucket)
        (own.repartition("_bucket") if key else own).write.partitionBy("_bucket").parquet(f"{self.root}/{name}")
        made = [f.getPath().getName() for f in self._fs.listStatus(self._path(name)) if f.isDirectory()]
        kept = {b: f for b, f in ((state or {}).get("buckets") or {}).items() if replaced is not None and int(b) not in replaced}
        new = {m.partition("=")[2]: f"{name}/{m}" for m in made}
        number = (state or {"number": 0})["number"] + 1
        if self._claim({"version": self.VERSION, "generation": name, "number": number, "schema": table.schema.jsonValue(), "buckets": kept | new}):
            return True
        self._fs.delete(self._path(name), True)
        return False

    def publish(self, table: DataFrame, expected: str | None, key: str | None = None) -> bool:
        """Replace the whole table; false if another generation was published since ``expected``."""
        state = self.current()
        return (state or {}).get("generation") == expected and self._write(table, key, state, None)

    def upsert(self, new: DataFrame, key: str, at: str, removed: DataFrame | None = None) -> bool:
        """Replace the buckets of the new and removed keys; false if another writer came first."""
        state = self.current()
        if state is None:
            return self._write(upsert(new.limit(0), new, key, at, removed), key, None, set())
        keys = new.select(key) if removed is None else new.select(key).unionByName(removed.select(key))
        touched = {r["b"] for r in keys.select(self._bucket(key).alias("b")).distinct().collect()}  # at most ``buckets`` numbers
        if set(state["buckets"]) == {"0"} and self.buckets > 1:  # published without a key: all of it
            touched = {*range(self.buckets)}
        return self._write(upsert(self._table(state, touched), new, key, at, removed), key, state, touched)

    def compact(self, keep: int = 2) -> int:
        """Delete manifests older than the ``keep`` latest and folders that none of these names; gives how many folders went."""
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(self._path("manifests")))
        used: set[str] = set()
        for n in names[-keep:]:
            stream = self._fs.open(self._path(f"manifests/{n}"))
            used |= {f.split("/")[0] for f in json.loads(bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())["buckets"].values()}
            stream.close()
        old = [f.getPath() for f in self._fs.listStatus(self._path("")) if f.getPath().getName().startswith("gen-") and f.getPath().getName() not in used]
        for n in names[:-keep]:
            self._fs.delete(self._path(f"manifests/{n}"), False)
        for path in old:
            self._fs.delete(path, True)
        return len(old)
