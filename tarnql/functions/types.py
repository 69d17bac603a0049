"""The type grammar of relations and their schemas.

A type is byte (0..255), short, int, long, float, double, char(n), text(n), or date, a calendar day that expressions see
as the number YYYYMMDD. char and text have a size in bytes and lose what is beyond it, and trailing blanks, on the way in.
"""

from __future__ import annotations

import json
import re
from collections import namedtuple
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAMMAR = re.compile(r"(byte|short|int|long|float|double|date)|(char|text)\((\d+)\)")
SPARK = {"byte": T.ShortType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "char": T.StringType(), "text": T.StringType()}
#: How expressions treat values of a type.
KINDS = {"byte": "int", "short": "int", "int": "int", "long": "int", "float": "float", "double": "float", "date": "date", "char": "str", "text": "str"}
DEFAULTS = {"int": 0, "float": 0.0, "str": "", "date": 19700101}


class Type:
    """One type of the grammar: its name and, for char and text, its size."""

    def __init__(self, text: str):
        m = GRAMMAR.fullmatch(text)
        if not m:
            raise ValueError(f"not a type: {text!r}")
        self.text, self.name, self.size = text, m[1] or m[2], int(m[3]) if m[3] else None

    def __eq__(self, other) -> bool:
        return isinstance(other, Type) and self.text == other.text

    def __hash__(self) -> int:
        return hash(self.text)

    def __repr__(self) -> str:
        return self.text

    @property
    def kind(self) -> str:
        return KINDS[self.name]

    @property
    def spark(self) -> T.DataType:
        return SPARK[self.name]

    @property
    def default(self):
        return DEFAULTS[self.kind]

    def parse(self, text: str):
        """The value that a field of a text file stands for; days are written YYYY-MM-DD or YYYYMMDD."""
        if self.kind == "date":
            return int(text.replace("-", ""))
        return int(text) if self.kind == "int" else float(text) if self.kind == "float" else self.clip(text)

    def clip(self, text: str) -> str:
        return text.encode()[: self.size].decode(errors="replace").rstrip("\0 \n")

    def stored(self, column: Column) -> Column:
        """A column of the same kind as a column of this type; values out of range are an error."""
        if self.name == "byte":
            inside = column.cast("int").between(0, 255)
            return F.when(inside, column.cast("short")).otherwise(F.raise_error(F.lit("byte out of range")).cast("short"))
        if self.size is not None:
            text = column.cast("string")
            cut = F.when(F.octet_length(text) <= self.size, text).otherwise(F.substring(F.encode(text, "utf-8"), 1, self.size).cast("string"))
            return F.regexp_replace(cut, r"[\x00 \n]+$", "")
        return column.cast(self.spark)


class Schema:
    """A relation's name and its fields in order."""

    def __init__(self, name: str, fields: Sequence[tuple[str, str]]):
        self.name, self.fields, self.types = name, [f for f, _ in fields], [t if isinstance(t, Type) else Type(t) for _, t in fields]
        if len(set(self.fields)) < len(self.fields):
            raise ValueError(f"a field occurs twice in {name}")
        self._row = namedtuple("Row", self.fields, rename=True)

    @classmethod
    def of(cls, name: str, df: DataFrame) -> Schema:
        """The schema of a DataFrame; strings become text of any size, days and times days."""
        names = {"tinyint": "short", "smallint": "short", "int": "int", "bigint": "long", "float": "float", "double": "double", "boolean": "short", "string": "text(2147483647)", "date": "date", "timestamp": "date", "timestamp_ntz": "date"}
        odd = [c for c, t in df.dtypes if t not in names and not t.startswith("decimal")]
        if odd:
            raise ValueError(f"no type for the columns {odd}")
        return cls(name, [(c, names.get(t, "double")) for c, t in df.dtypes])

    def schema(self) -> list[tuple[str, str]]:
        return [(f, t.text) for f, t in zip(self.fields, self.types)]

    def type_of(self, field: str) -> Type:
        return self.types[self.fields.index(field)]

    def instantiate(self, *values):
        return self._row(*values)

    def default(self):
        return self._row(*(t.default for t in self.types))

    def rename(self, name: str, names: Mapping[str, str]) -> Schema:
        """All fields under new names, in order."""
        return Schema(name, [(names[f], t) for f, t in zip(self.fields, self.types)])

    def match(self, other: Schema) -> bool:
        return self.schema() == other.schema()

    def project(self, row, other: Schema):
        """The fields of other from a row of this schema."""
        lost = [f for f in other.fields if f not in self.fields]
        if lost:
            raise ValueError(f"{self.name} has no fields {lost}")
        return other.instantiate(*(row[self.fields.index(f)] for f in other.fields))

    def values_from_strings(self, texts: Sequence[str]) -> list:
        return [t.parse(x) for t, x in zip(self.types, texts)]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f, t.spark, False) for f, t in zip(self.fields, self.types)])

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "fields": self.schema()})

    @classmethod
    def from_json(cls, text: str) -> Schema:
        x = json.loads(text)
        return cls(x["name"], [tuple(f) for f in x["fields"]])

    def __repr__(self) -> str:
        return f"{self.name}[{','.join(f'({f},{t})' for f, t in self.schema())}]"


def day_number(column: Column) -> Column:
    """A date or time as YYYYMMDD."""
    return F.year(column) * 10000 + F.month(column) * 100 + F.dayofmonth(column)
