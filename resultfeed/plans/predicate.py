"""WHERE clauses as three-valued predicates over rows before and after a change.

``parse`` reads what pruning understands: comparisons of a column with a literal in either order, IN, IS [NOT] NULL,
BETWEEN, NOT, AND, OR and brackets.  Any other deterministic expression over the row stays as text and is evaluated by
Spark; one with a subquery is opaque (unknown).  Comparisons cast the column to the literal's kind with ``try_cast``,
so a value that doesn't convert is unknown, not an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect import _joined, to_spark
from .lexer import NUMBER, OP, QUOTED, STRING, WORD, Token, closing, code, tokenize

MATCH, NO_MATCH, UNKNOWN = "match", "no_match", "unknown"
_MIRROR = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
#: Functions whose value depends on more than the row.
UNSTABLE = {"rand", "random", "randn", "uuid", "gen_random_uuid", "now", "current_timestamp", "current_date", "current_time", "localtimestamp", "localtime", "clock_timestamp", "shuffle", "monotonically_increasing_id"}


class Pred:
    """``column(schema)``: true, false, or null for unknown."""

    def column(self, schema: T.StructType) -> Column:
        raise NotImplementedError

    def opaque(self) -> bool:
        return False


def _field(schema: T.StructType, name: str) -> tuple[Column, T.DataType] | None:
    found = next((f for f in schema.fields if f.name.lower() == name.lower()), None)
    return None if found is None else (F.col(f"`{found.name}`"), found.dataType)


@dataclass(frozen=True)
class Compare(Pred):
    name: str
    op: str
    value: object

    def column(self, schema: T.StructType) -> Column:
        at = _field(schema, self.name)
        if at is None or self.value is None:
            return F.lit(None).cast("boolean")
        c, kind = at
        if isinstance(self.value, bool):
            left, right = c.cast("string").try_cast("boolean") if not isinstance(kind, T.BooleanType) else c, F.lit(self.value)
        elif isinstance(self.value, (int, float)):
            numeric = isinstance(kind, (T.NumericType, T.DecimalType))
            left = c if numeric else c.try_cast("double") if isinstance(kind, T.StringType) else F.lit(None).cast("double")
            right = F.lit(self.value)
        else:
            if isinstance(kind, (T.StringType, T.BinaryType)):
                left, right = c.cast("string"), F.lit(self.value)
            else:
                left, right = c, F.lit(self.value).try_cast(kind)
        return {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[self.op]


@dataclass(frozen=True)
class In(Pred):
    name: str
    values: tuple
    negated: bool = False

    def column(self, schema: T.StructType) -> Column:
        out = Any_(tuple(Compare(self.name, "=", v) for v in self.values)).column(schema)
        return ~out if self.negated else out


@dataclass(frozen=True)
class IsNull(Pred):
    name: str
    negated: bool = False

    def column(self, schema: T.StructType) -> Column:
        at = _field(schema, self.name)
        if at is None:
            return F.lit(None).cast("boolean")
        return at[0].isNotNull() if self.negated else at[0].isNull()


@dataclass(frozen=True)
class All(Pred):
    parts: tuple[Pred, ...]

    def column(self, schema: T.StructType) -> Column:
        out = F.lit(True)
        for p in self.parts:
            out = out & p.column(schema)
        return out

    def opaque(self) -> bool:
        return all(p.opaque() for p in self.parts)  # a clear conjunct can rule rows out


@dataclass(frozen=True)
class Any_(Pred):
    parts: tuple[Pred, ...]

    def column(self, schema: T.StructType) -> Column:
        out = F.lit(False)
        for p in self.parts:
            out = out | p.column(schema)
        return out

    def opaque(self) -> bool:
        return any(p.opaque() for p in self.parts)


@dataclass(frozen=True)
class Not(Pred):
    part: Pred

    def column(self, schema: T.StructType) -> Column:
        return ~self.part.column(schema)

    def opaque(self) -> bool:
        return self.part.opaque()


@dataclass(frozen=True)
class Expression(Pred):
    """Any other expression of the row, in Spark's dialect."""

    sql: str

    def column(self, schema: T.StructType) -> Column:
        return F.expr(self.sql)


@dataclass(frozen=True)
class Opaque(Pred):
    """Depends on more than the row."""

    sql: str

    def column(self, schema: T.StructType) -> Column:
        return F.lit(None).cast("boolean")

    def opaque(self) -> bool:
        return True


def _split(tokens: list[Token], word: str) -> list[list[Token]]:
    """Parts between ``word`` outside brackets, CASE and BETWEEN .. AND."""
    parts, at, i, between, case = [], 0, 0, 0, 0
    while i < len(tokens):
        t = tokens[i]
        if t.kind == OP and t.text == "(":
            i = closing(tokens, i)
        elif t.word == "case":
            case += 1
        elif t.word == "end":
            case -= 1
        elif t.word == "between":
            between += 1
        elif t.word == "and" and between and not case:
            between -= 1
        elif t.word == word and not case:
            parts.append(tokens[at:i])
            at = i + 1
        i += 1
    return [*parts, tokens[at:]]


def _name(tokens: list[Token]) -> str | None:
    if not tokens or len(tokens) % 2 == 0:
        return None
    for k, t in enumerate(tokens):
        if k % 2 and t.text != "." or not k % 2 and t.kind not in (WORD, QUOTED):
            return None
    last = tokens[-1]
    if len(tokens) == 1 and last.word in ("true", "false", "null", "current_date", "current_timestamp"):
        return None
    return last.value if last.kind == QUOTED else last.text.lower()


_NO = object()  # not a literal


def _literal(tokens: list[Token]) -> object:
    if len(tokens) == 2 and tokens[0].text == "-" and tokens[1].kind == NUMBER:
        value = _literal(tokens[1:])
        return -value
    if len(tokens) != 1:
        return _NO
    t = tokens[0]
    if t.kind == NUMBER:
        return int(t.text) if t.text.isdigit() else float(t.text)
    if t.kind == STRING and not t.escaped:
        return t.value
    return {"true": True, "false": False, "null": None}.get(t.word, _NO)


def _atom(tokens: list[Token]) -> Pred:
    if not tokens:
        raise ValueError("empty predicate")
    if tokens[0].text == "(" and tokens[0].kind == OP and closing(tokens, 0) == len(tokens) - 1 and tokens[1].word not in ("select", "with", "values"):
        return parse_tokens(tokens[1:-1])
    if tokens[0].word == "not":
        return Not(parse_tokens(tokens[1:]))
    words = [t.word for t in tokens]
    for tail, negated in ((["is", "null"], False), (["is", "not", "null"], True)):
        if words[-len(tail) :] == tail and (name := _name(tokens[: -len(tail)])):
            return IsNull(name, negated)
    if "in" in words and tokens[-1].text == ")":
        at = words.index("in")
        negated = words[at - 1] == "not"
        name, body = _name(tokens[: at - negated]), tokens[at + 2 : -1]
        if name and tokens[at + 1].text == "(" and closing(tokens, at + 1) == len(tokens) - 1 and body and body[0].word not in ("select", "with"):
            values, item = [], []
            for t in [*body, Token(OP, ",")]:
                if t.kind == OP and t.text == ",":
                    values.append(_literal(item))
                    item = []
                else:
                    item.append(t)
            if _NO not in values:
                return In(name, tuple(values), negated)
    if "between" in words:
        at = words.index("between")
        parts = _split(tokens[at + 1 :], "and")
        if words[at - 1] != "not" and (name := _name(tokens[:at])) and len(parts) == 2:
            low, high = (_literal(p) for p in parts)
            if low is not _NO and high is not _NO:
                return All((Compare(name, ">=", low), Compare(name, "<=", high)))
    ops = [i for i, t in enumerate(tokens) if t.kind == OP and (t.text in _MIRROR or t.text == "!=")]
    if len(ops) == 1:
        op = "<>" if tokens[ops[0]].text == "!=" else tokens[ops[0]].text
        left, right = tokens[: ops[0]], tokens[ops[0] + 1 :]
        if (name := _name(left)) and (value := _literal(right)) is not _NO:
            return Compare(name, op, value)
        if (name := _name(right)) and (value := _literal(left)) is not _NO:
            return Compare(name, _MIRROR[op], value)
    text = _joined(tokens)
    if any(w in ("select", "exists", "over") or w in UNSTABLE for w in words):
        return Opaque(text)
    return Expression(to_spark(text))


def parse_tokens(tokens: list[Token]) -> Pred:
    if len(parts := _split(tokens, "or")) > 1:
        return Any_(tuple(parse_tokens(p) for p in parts))
    if len(parts := _split(tokens, "and")) > 1:
        flat: list[Pred] = []
        for p in map(parse_tokens, parts):
            flat += p.parts if isinstance(p, All) else (p,)
        return All(tuple(flat))
    return _atom(tokens)


def parse(sql: str) -> Pred:
    return parse_tokens(code(tokenize(sql)))


def tri_state(df: DataFrame, pred: Pred) -> Column:
    """match, no_match or unknown for each row; a column that is missing is unknown."""
    c = pred.column(df.schema)
    return F.when(c, MATCH).when(~c, NO_MATCH).otherwise(UNKNOWN)


def tri_state_json(df: DataFrame, column: str, schema: T.StructType, pred: Pred, name: str = "r") -> DataFrame:
    """``df`` with a verdict for rows that come as JSON text in ``column``; a field that is absent counts as null."""
    placed = [f"__{i}" for i in range(len(df.columns))]
    typed = df.toDF(*placed).select("*", F.from_json(placed[df.columns.index(column)], schema).alias("__row")).select(*placed, "__row.*")
    return typed.select(*[F.col(p).alias(c) for p, c in zip(placed, df.columns, strict=True)], tri_state(typed, pred).alias(name))


def may_match(schema: T.StructType, pred: Pred) -> Column:
    """Whether a row can be in the result: anything but a clear no."""
    return F.coalesce(pred.column(schema), F.lit(True))
