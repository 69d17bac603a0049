"""The database: relations kept as Parquet below one folder, with a catalog that survives a restart.

A relation is a folder of Parquet versions; the catalog file names the one in force. A change is one rewrite followed by one small
write, and the version before stays until the next change, for readers that began with it. Relations may also be attached: files or DataFrames that are
kept elsewhere. Indexes are metadata: a lookup is an equality that Parquet's statistics prune, on rows that may be
clustered by the key.
"""

from __future__ import annotations

import datetime
import json
import re
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import compile_expression, compile_predicate, environment
from ..functions.types import Schema
from ..operators.rows import checked
from ..operators.scan import TableScan
from ..plans.builder import PlanBuilder
from ..plans.joinorder import PLANNERS, Planner
from ..plans.plan import Plan


class Database:
    """Relations, indexes and queries over them. folder None keeps nothing: only attached relations are possible then."""

    def __init__(self, spark: SparkSession, folder: str | None = None, planner: str = "left-deep"):
        self.spark, self.folder, self.planner = spark, folder, PLANNERS[planner]()
        self._relations: dict[str, dict] = {}
        self._attached: dict[str, tuple[Schema, DataFrame]] = {}
        self._indexes: dict[str, dict] = {}
        self._number = 0  # of the catalog file that was read or written last
        if folder is not None:
            self.restore()

    # -- catalog ---------------------------------------------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def checkpoint(self) -> None:
        """Writes the catalog as a new file of the next number, which counts from its renaming on; the file before stays, older ones go.
        A crash at any point leaves a complete catalog: the new one or the one before. If another session has taken the number, that is an error."""
        if self.folder is None:
            return
        text = json.dumps({"relations": self._relations, "indexes": self._indexes})
        number = self._number + 1
        new, named = self._path(f"_catalog-{uuid.uuid4().hex}"), self._path(f"catalog-{number:012d}.json")
        fs = self._fs(new)
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(named) or not fs.rename(new, named):
            fs.delete(new, False)
            raise RuntimeError(f"the catalog of {self.folder} was changed by another session; restore() reads it")
        self._number = number
        for k, path in self._catalogs():
            if k < number - 1:
                fs.delete(path, False)

    def _catalogs(self) -> list[tuple[int, object]]:
        """The numbers and paths of the catalog files, oldest first."""
        top = self._path()
        fs = self._fs(top)
        names = {s.getPath().getName(): s.getPath() for s in fs.listStatus(top)} if fs.exists(top) else {}
        return sorted((int(m[1]), path) for name, path in names.items() if (m := re.fullmatch(r"catalog-(\d+)\.json", name)))

    def restore(self) -> None:
        """Reads the newest catalog of the folder, if there is one."""
        found = self._catalogs()
        self._number = found[-1][0] if found else 0
        if found:
            text = self.spark.read.text(found[-1][1].toString(), wholetext=True).first()[0]
            x = json.loads(text)
            self._relations, self._indexes = x["relations"], x["indexes"]

    def relations(self) -> list[str]:
        return sorted({*self._relations, *self._attached})

    def has_relation(self, name: str) -> bool:
        return name in self._relations or name in self._attached

    def relation_schema(self, name: str) -> Schema | None:
        if name in self._attached:
            return self._attached[name][0]
        return Schema.from_json(self._relations[name]["schema"]) if name in self._relations else None

    def _known(self, name: str) -> Schema:
        schema = self.relation_schema(name)
        if schema is None:
            raise ValueError(f"no relation {name!r}")
        return schema

    def create_relation(self, name: str, fields: Sequence[tuple[str, str]]) -> Schema:
        if self.has_relation(name):
            raise ValueError(f"there is a relation {name!r} already")
        if self.folder is None:
            raise ValueError("a database without a folder keeps no relations")
        schema = Schema(name, fields)
        self._relations[name] = {"schema": schema.to_json(), "version": None}
        self.checkpoint()
        return schema

    def remove_relation(self, name: str, detach: bool = False) -> None:
        """Forgets a relation and its indexes, and deletes its files unless detach."""
        self._known(name)
        if name in self._attached:
            del self._attached[name]
        else:
            del self._relations[name]
            if not detach:
                path = self._path(name)
                self._fs(path).delete(path, True)
        self._indexes = {k: x for k, x in self._indexes.items() if x["relation"] != name}
        self.checkpoint()

    def attach(self, name: str, df: DataFrame, schema: Schema | None = None) -> Schema:
        """Adds a relation whose rows are kept elsewhere. Its columns are taken as they are, and only read as they are needed."""
        if self.has_relation(name):
            raise ValueError(f"there is a relation {name!r} already")
        schema = Schema.of(name, df) if schema is None else schema
        if schema.fields != df.columns:
            raise ValueError(f"{schema} does not name the columns {df.columns}")
        self._attached[name] = schema, df
        return schema

    def attach_files(self, name: str, fields: Sequence[tuple[str, str]]) -> Schema:
        """Takes up a relation's newest version that is in the folder but not in the catalog, as after remove_relation with detach."""
        if self.has_relation(name):
            raise ValueError(f"there is a relation {name!r} already")
        path = self._path(name)
        fs = self._fs(path)
        found = list(fs.listStatus(path)) if fs.exists(path) else []
        if not found:
            raise ValueError(f"no files of {name!r}")
        newest = max(found, key=lambda s: s.getModificationTime()).getPath().getName()
        self._relations[name] = {"schema": Schema(name, fields).to_json(), "version": newest}
        self.checkpoint()
        return self._known(name)

    # -- rows ------------------------------------------------------------------------------------------------------

    def df(self, name: str) -> DataFrame:
        """A relation's rows now."""
        schema = self._known(name)
        if name in self._attached:
            return self._attached[name][1]
        version = self._relations[name]["version"]
        if version is None:
            return self.spark.createDataFrame([], schema.struct())
        return self.spark.read.schema(schema.struct()).parquet(self._path(name, version).toString())

    def _replace(self, name: str, rows: DataFrame) -> None:
        if name in self._attached:
            raise ValueError(f"{name!r} is attached, and not changed from here")
        entry, version = self._relations[name], f"v-{uuid.uuid4().hex}"
        rows.write.parquet(self._path(name, version).toString())
        oldest, entry["previous"], entry["version"] = entry.get("previous"), entry["version"], version
        self.checkpoint()
        if oldest is not None:
            path = self._path(name, oldest)
            self._fs(path).delete(path, True)

    def _stored(self, schema: Schema, rows) -> DataFrame:
        if not isinstance(rows, DataFrame):
            kinds = {"int": "long", "float": "double", "str": "string", "date": "long"}
            ddl = ", ".join(f"`{f}` {kinds[t.kind]}" for f, t in zip(schema.fields, schema.types))
            rows = self.spark.createDataFrame([tuple(float(x) if t.kind == "float" else x for x, t in zip(r, schema.types, strict=True)) for r in rows], ddl)
        if rows.columns != schema.fields:
            raise ValueError(f"{schema} does not name the columns {rows.columns}")
        out = []
        for f, t in zip(schema.fields, schema.types):
            c = F.col(f"`{f}`")
            if t.kind == "date" and dict(rows.dtypes)[f] not in ("date", "timestamp", "timestamp_ntz"):
                c = F.to_date(c.cast("string"), "yyyyMMdd")
            stored = t.stored(c)
            out.append(F.when(stored.isNotNull(), stored).otherwise(F.raise_error(F.lit(f"null in {schema.name}.{f}")).cast(t.spark)).alias(f))
        return rows.select(*out)

    def insert(self, name: str, rows: DataFrame | Iterable[Sequence]) -> None:
        """Appends rows, checked against the schema; a primary index refuses keys that occur twice. Many rows at a time: every call writes files.

        Only the new keys are grouped; the relation's own are looked through for them by a semi-join, which broadcasts the new keys
        while they are few.
        """
        schema = self._known(name)
        if name in self._attached:
            raise ValueError(f"{name!r} is attached, and not changed from here")
        new = self._stored(schema, rows)
        for index in self._of(name, primary=True):
            key = index["key"]
            keys = new.groupBy(*key).count()
            twice = keys.where("count > 1").select(*key).limit(1).collect() or self.df(name).select(*key).join(keys, key, "left_semi").limit(1).collect()
            if twice:
                raise ValueError(f"the key {tuple(twice[0])} occurs twice in {name!r}")
        entry = self._relations[name]
        if entry["version"] is None:
            self._replace(name, new)
        else:
            new.write.mode("append").parquet(self._path(name, entry["version"]).toString())

    def delete_where(self, name: str, expression: str) -> None:
        gone = compile_predicate(expression, environment(self._known(name)))
        self._replace(name, self.df(name).where(~gone))

    def update_where(self, name: str, expression: str, values: Mapping[str, str]) -> None:
        """Sets columns to expressions of the old row where an expression holds."""
        schema = self._known(name)
        env = environment(schema)
        hit = compile_predicate(expression, env)
        new = {c: checked(compile_expression(e, env), schema.type_of(c), c) for c, e in values.items()}
        self._replace(name, self.df(name).select(*[F.when(hit, new[f]).otherwise(F.col(f"`{f}`")).alias(f) if f in new else F.col(f"`{f}`") for f in schema.fields]))

    def with_tuple_ids(self, name: str, id_col: str = "tuple_id") -> DataFrame:
        """A kept relation's rows, each with its id: the file it is in and its place there. Ids hold until the relation is rewritten."""
        if name in self._attached:
            raise ValueError(f"{name!r} is attached, and has no tuple ids")
        return self.df(name).withColumn(id_col, F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place")))

    def _marked(self, name: str, ids: Iterable[tuple[str, int]]) -> DataFrame:
        """The rows with their ids, and whether an id is among some given ones, which are joined by it."""
        given = self.spark.createDataFrame([(tuple(x),) for x in ids], "_given struct<file:string,place:long>").distinct()
        rows = self.with_tuple_ids(name, "_id")
        return rows.join(given, F.col("_id") == F.col("_given"), "left")

    def delete_tuples(self, name: str, ids: Iterable[tuple[str, int]]) -> None:
        """Deletes the rows with some tuple ids; ids that no row has are passed over."""
        self._replace(name, self._marked(name, ids).where("_given is null").drop("_id", "_given"))

    def update_tuples(self, name: str, ids: Iterable[tuple[str, int]], new: Mapping[str, object]) -> None:
        """Sets columns to values in the rows with some tuple ids."""
        schema = self._known(name)
        lost = [f for f in new if f not in schema.fields]
        if lost:
            raise ValueError(f"{name!r} has no fields {lost}")
        one = self._stored(Schema("new", [(f, schema.type_of(f)) for f in new]), [tuple(new.values())])
        rows = self._marked(name, ids)
        for f in new:
            value = F.lit(one.first()[f])
            rows = rows.withColumn(f, F.when(F.col("_given").isNotNull(), value).otherwise(F.col(f"`{f}`")).cast(schema.type_of(f).spark))
        self._replace(name, rows.select(*[F.col(f"`{f}`") for f in schema.fields]))

    def load_text(self, name: str, path: str, fraction: float = 1.0) -> None:
        """Appends the rows of a pipe-separated text file; a missing file is an error."""
        from .files import read_pipe_text

        self.insert(name, read_pipe_text(self.spark, path, self._known(name), fraction))

    def relation_stats(self, name: str) -> tuple[int, int, int]:
        """(bytes of an average file, files, rows): the relation's units of storage, and its exact count."""
        df = self.df(name)
        files = df.inputFiles()
        total = sum(self._fs(p).getFileStatus(p).getLen() for p in map(self.spark._jvm.org.apache.hadoop.fs.Path, files))
        return total // max(1, len(files)), len(files), df.count()

    def tuples(self, name: str) -> Iterator[Row]:
        """Rows one by one, a partition at a time on the driver."""
        return self.df(name).toLocalIterator()

    def pages(self, name: str) -> Iterator:
        """Arrow batches, one after the other."""
        import pyarrow as pa

        def packed(batches):
            for b in batches:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as w:
                    w.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["page"])

        for row in self.df(name).mapInArrow(packed, "page binary").toLocalIterator():
            yield from pa.ipc.open_stream(row["page"])

    def headers(self, name: str) -> DataFrame:
        from .files import file_headers

        return file_headers(self.spark, self.df(name))

    def cache(self, name: str) -> None:
        """Keeps a relation's rows in the executors' memory until evict."""
        schema, df = self._known(name), self.df(name).cache()
        self._attached[name] = schema, df

    def evict(self, name: str) -> None:
        _, df = self._attached[name]
        df.unpersist()
        if name in self._relations:
            del self._attached[name]

    # -- indexes ---------------------------------------------------------------------------------------------------

    def _of(self, name: str, primary: bool | None = None) -> list[dict]:
        return [x for x in self._indexes.values() if x["relation"] == name and (primary is None or x["primary"] == primary)]

    def create_index(self, name: str, key: Sequence[str], primary: bool = False) -> str:
        """Adds an index of a relation on fields; at most one is primary (unique), and no two have the same key. Rows that are there take part."""
        schema = self._known(name)
        lost = [f for f in key if f not in schema.fields]
        if lost:
            raise ValueError(f"{name!r} has no fields {lost}")
        if primary and self._of(name, True):
            raise ValueError(f"{name!r} has a primary index already")
        if any(x["key"] == list(key) for x in self._of(name)):
            raise ValueError(f"{name!r} has an index on {list(key)} already")
        if primary and self.df(name).groupBy(*key).count().where("count > 1").limit(1).collect():
            raise ValueError(f"{list(key)} is no key of {name!r}")
        index = f"index-{uuid.uuid4().hex[:12]}"
        self._indexes[index] = {"relation": name, "key": list(key), "primary": primary}
        self.checkpoint()
        return index

    def remove_index(self, index: str) -> None:
        if index not in self._indexes:
            raise ValueError(f"no index {index!r}")
        del self._indexes[index]
        self.checkpoint()

    def has_index(self, index: str) -> bool:
        return index in self._indexes

    def match_index(self, name: str, key: Schema) -> str | None:
        """The index of a relation on exactly these fields and types, in order."""
        schema = self._known(name)
        if any(f not in schema.fields or schema.type_of(f) != t for f, t in zip(key.fields, key.types)):
            return None
        return next((k for k, x in self._indexes.items() if x["relation"] == name and x["key"] == key.fields), None)

    def index_key(self, index: str, name: str) -> list[str]:
        found = self._indexes.get(index)
        if found is None or found["relation"] != name:
            raise ValueError(f"no index {index!r} of {name!r}")
        return found["key"]

    def cluster(self, index: str, partitions: int | None = None) -> None:
        """Rewrites an index's relation in ranges of its key, so that lookups and key ranges skip most files and row groups."""
        found = self._indexes[index]
        name, key = found["relation"], found["key"]
        rows = self.df(name)
        rows = rows.repartitionByRange(*([partitions] if partitions else []), *key).sortWithinPartitions(*key)
        self._replace(name, rows)

    def lookup(self, index: str, *values) -> DataFrame | None:
        """The rows whose key has these values; None without such an index."""
        found = self._indexes.get(index)
        return None if found is None else self.df(found["relation"]).where(self._equal(found, values))

    def _equal(self, found: dict, values) -> Column:
        schema, out = self._known(found["relation"]), F.lit(True)
        for f, v in zip(found["key"], values, strict=True):
            c = F.col(f"`{f}`")
            if schema.type_of(f).kind == "date":  # there may be times behind the days; both bounds reach the scan
                day = datetime.datetime.strptime(str(v), "%Y%m%d").date()
                out = out & (c >= F.lit(day)) & (c < F.lit(day + datetime.timedelta(1)))
            else:
                out = out & (c == F.lit(v))
        return out

    def _primary(self, name: str) -> str:
        found = [k for k, x in self._indexes.items() if x["relation"] == name and x["primary"]]
        if not found:
            raise ValueError(f"{name!r} has no primary index")
        return found[0]

    def lookup_by_key(self, name: str, *values) -> DataFrame:
        return self.lookup(self._primary(name), *values)

    def scan_by_index(self, index: str) -> DataFrame:
        """Rows in the order of an index's key."""
        found = self._indexes[index]
        return self.df(found["relation"]).orderBy(*found["key"])

    def delete_by_index(self, index: str, *values) -> None:
        found = self._indexes[index]
        self._replace(found["relation"], self.df(found["relation"]).where(~self._equal(found, values)))

    def update_by_index(self, index: str, values: Sequence, new: Mapping[str, object]) -> None:
        """Sets columns to values in the rows whose key has the given ones."""
        found = self._indexes[index]
        name = found["relation"]
        schema, hit = self._known(name), self._equal(found, values)
        columns = [F.when(hit, schema.type_of(f).stored(F.lit(new[f]))).otherwise(F.col(f"`{f}`")).alias(f) if f in new else F.col(f"`{f}`") for f in schema.fields]
        self._replace(name, self.df(name).select(*columns))

    def delete_by_key(self, name: str, *values) -> None:
        self.delete_by_index(self._primary(name), *values)

    def update_by_key(self, name: str, values: Sequence, new: Mapping[str, object]) -> None:
        self.update_by_index(self._primary(name), values, new)

    # -- queries ---------------------------------------------------------------------------------------------------

    def scan(self, name: str) -> TableScan:
        return TableScan(name, self._known(name), lambda: self.df(name))

    def query(self) -> PlanBuilder:
        return PlanBuilder(self)

    def process(self, plan: Plan) -> DataFrame:
        return plan.df()

    def optimize(self, plan: Plan, planner: Planner | str | None = None) -> Plan:
        """The plan with its joins reordered, by the database's planner or another."""
        planner = PLANNERS[planner]() if isinstance(planner, str) else planner or self.planner
        return planner.optimize(plan)
