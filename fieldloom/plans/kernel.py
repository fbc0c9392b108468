"""A kernel language that compiles Python functions to DataFrame plans.

``@kernel`` reads a function's source once. Called with frames and scalars, it becomes column expressions: the top-level
loop is the domain, locals are columns, ``if`` predicates assignments, short inner ``range`` loops are unrolled, other inner
loops run inside ``aggregate`` (what they load is exploded, joined and collected before; a ``while`` loop of linear steps on
integers leaps over trips that repeat each other; one that has not ended after ``while_bound`` steps, a trip or a leap each, fails
the query), loads at computed indices are joins, stores at computed
indices are keyed aggregates, and ``@func`` helpers are inlined. Nothing runs per row in Python.

    @kernel
    def saxpy(x, y, out, a, n):
        for i in range(n):
            out[i] = a * x[i] + y[i]

    out = saxpy(x, y, None, 2.0, 1000)["out"]      # fields are (idx, val) frames; None is a field to be made

Semantics: integer ``//`` and ``%`` truncate toward zero; ``/`` is true division with IEEE results; comparisons with NaN are
false; ``and``/``or`` evaluate both sides; of several stores to one place the highest loop index holds; a load sees what its own
iteration has stored, and else the field as it was before the kernel. A kernel has one top-level loop;
what the language lacks raises ``NotImplementedError``.
"""

from __future__ import annotations

import ast
import inspect as _inspect
import itertools
import textwrap
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import ieee, types as ty
from fieldloom.sources.field import Field, unpack

UNROLL = 64  # longest inner loop that is unrolled
GATHERED = 8  # longest inner loop with loads that is unrolled
WHILE = 1 << 16  # default bound of a while loop
FAR = 1 << 62  # trips of a leap that no comparison limits
TRIPS = 256  # trips between two checks of whether a row's while loop has ended
_FUNCS: dict[str, Callable] = {}
_ATOMICS = {"atomic_add": "add", "atomic_min": "min", "atomic_max": "max"}
_BLOCKS = {"block_sum": F.sum, "block_min": F.min, "block_max": F.max}
_CASTS = {"int": ty.i32, "float": ty.f32, **ty.ALL}


class KernelError(NotImplementedError):
    """A construct that the kernel language lacks."""


def _tree(f: Callable) -> ast.FunctionDef:
    try:
        source = textwrap.dedent(_inspect.getsource(f))
    except OSError as e:
        raise RuntimeError(f"the source of {f.__name__} cannot be read") from e
    return next(n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.FunctionDef))


class Func:
    """A helper that kernels inline; it cannot be called from Python."""

    def __init__(self, f: Callable):
        self.name, self.tree = f.__name__, _tree(f)
        _FUNCS[self.name] = self

    def __call__(self, *a):
        raise RuntimeError(f"{self.name} can only be called inside a kernel")


func = Func


class Vec(list):
    """A vector value: a list of columns."""


class Value:
    """A column with what is known of its type: i (integer), f (float) or b (comparison)."""

    __slots__ = ("c", "kind", "const")

    def __init__(self, c: Column, kind: str, const: Any = None):
        self.c, self.kind, self.const = c, kind, const


def _const(x) -> Value:
    return Value(F.lit(x).cast("bigint") if isinstance(x, int) and not isinstance(x, bool) else F.lit(x), "f" if isinstance(x, float) else "i", x)


def _num(v: Value) -> Value:
    return Value(v.c.cast("bigint"), "i") if v.kind == "b" else v


def _bool(v: Value) -> Column:
    return v.c if v.kind == "b" else v.c != 0


class _Return(Exception):
    pass


class Compiler:
    """One kernel call being turned into frames."""

    def __init__(self, tree: ast.FunctionDef, args: dict[str, Any], spark: SparkSession, while_bound: int):
        self.tree, self.spark, self.bound = tree, spark, while_bound
        self.fields = {k: v for k, v in args.items() if v is None or isinstance(v, (Field, DataFrame))}
        self.args = {k: v for k, v in args.items() if k not in self.fields}
        self.env: dict[str, Any] = {}
        self.stores: list[tuple[str, Column, Any, Column, str]] = []  # field, index, value, predicate, combine
        self.loads: dict[tuple, list[tuple[list, Column, Any]]] = {}
        self.keys = ["__idx"]  # columns that tell the rows of the working frame apart
        self.fresh = itertools.count()
        self.df: DataFrame | None = None
        self.trace: list[str] = []
        self.axes: list[str] = []

    # ---- frames
    def settle(self, value: Column, stem: str) -> Column:
        """A value as a column of the working frame, so that it is computed once and expressions stay small."""
        name = f"__{stem}{next(self.fresh)}"
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def frame(self, name: str) -> DataFrame:
        f = self.fields[name]
        if f is None:
            raise KernelError(f"{name} is read before it is made")
        return f.df if isinstance(f, Field) else f

    def shape(self, name: str) -> tuple[int, ...]:
        f = self.fields[name]
        if isinstance(f, Field):
            return f.shape
        if f is None:
            raise KernelError(f"the shape of {name} is unknown")
        return (f.count(),)

    def kind_of(self, name: str) -> str:
        t = self.frame(name).schema["val"].dataType
        return "f" if isinstance(t, (T.FloatType, T.DoubleType)) else "i"

    # ---- expressions
    def expr(self, n: ast.AST) -> Any:
        method = getattr(self, f"on_{type(n).__name__}", None)
        if method is None:
            raise KernelError(f"{type(n).__name__} is not in the kernel language")
        return method(n)

    def on_Constant(self, n):
        if isinstance(n.value, bool):
            return Value(F.lit(n.value), "b", n.value)
        if not isinstance(n.value, (int, float)):
            raise KernelError(f"constant {n.value!r}")
        return _const(n.value)

    def on_Name(self, n):
        if n.id in self.env:
            return self.env[n.id]
        if n.id in self.args:
            v = self.args[n.id]
            return _const(v.item() if hasattr(v, "item") else v) if isinstance(v, (int, float)) or hasattr(v, "item") else v
        raise KernelError(f"unknown name {n.id}")

    def on_UnaryOp(self, n):
        v = self.expr(n.operand)
        if isinstance(v, Vec):
            return Vec([Value(-x.c, x.kind) for x in v])
        if isinstance(n.op, ast.Not):
            return Value(~_bool(v), "b")
        v = _num(v)
        if isinstance(n.op, ast.USub):
            return Value(-v.c, v.kind, -v.const if v.const is not None else None)
        if isinstance(n.op, ast.Invert):
            return Value(F.bitwise_not(v.c), "i")
        return v

    def on_BinOp(self, n):
        return self.binary(type(n.op), self.expr(n.left), self.expr(n.right))

    def binary(self, op, a, b):
        if isinstance(a, Vec) or isinstance(b, Vec):
            if isinstance(a, Vec) and isinstance(b, Vec) and len(a) != len(b):
                raise TypeError("vectors of different lengths")
            m = len(a) if isinstance(a, Vec) else len(b)
            at = lambda v, k: v[k] if isinstance(v, Vec) else v
            return Vec([self.binary(op, at(a, k), at(b, k)) for k in range(m)])
        a, b = _num(a), _num(b)
        ints = a.kind == b.kind == "i"
        known = a.const is not None and b.const is not None
        if known and ints and op in (ast.Add, ast.Sub, ast.Mult):
            return _const({ast.Add: a.const + b.const, ast.Sub: a.const - b.const, ast.Mult: a.const * b.const}[op])
        kind = "i" if ints else "f"
        if op is ast.Add:
            return Value(a.c + b.c, kind)
        if op is ast.Sub:
            return Value(a.c - b.c, kind)
        if op is ast.Mult:
            return Value(a.c * b.c, kind)
        if op is ast.Div:
            return Value(ieee.fdiv(a.c, b.c), "f")
        if op is ast.FloorDiv:
            return Value(ieee.idiv(a.c, b.c), "i") if ints else Value(F.floor(ieee.fdiv(a.c, b.c)).cast("double"), "f")
        if op is ast.Mod:
            return Value(ieee.irem(a.c, b.c), "i") if ints else Value(ieee.frem(a.c, b.c), "f")
        if op is ast.Pow:
            p = F.pow(a.c, b.c)
            return Value(p.cast("bigint"), "i") if ints else Value(p, "f")
        if op in (ast.LShift, ast.RShift):
            f = F.call_function("shiftleft" if op is ast.LShift else "shiftright", a.c.cast("bigint"), b.c.cast("int"))
            return Value(f, "i")
        if op in (ast.BitAnd, ast.BitOr, ast.BitXor):
            f = {ast.BitAnd: a.c.bitwiseAND, ast.BitOr: a.c.bitwiseOR, ast.BitXor: a.c.bitwiseXOR}[op]
            return Value(f(b.c), "i")
        raise KernelError(op.__name__)

    def on_Compare(self, n):
        ops = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
        left, out = self.expr(n.left), None
        for op, r in zip(n.ops, n.comparators, strict=True):
            if type(op) not in ops:
                raise KernelError(f"comparison {type(op).__name__}")
            right = self.expr(r)
            a, b = _num(left), _num(right)
            c = ieee.compare(ops[type(op)], a.c, b.c, "f" in (a.kind, b.kind))
            out, left = c if out is None else out & c, right
        return Value(out, "b")

    def on_BoolOp(self, n):
        parts = [_bool(self.expr(v)) for v in n.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(n.op, ast.And) else out | p
        return Value(out, "b")

    def on_IfExp(self, n):
        return self.choose(_bool(self.expr(n.test)), self.expr(n.body), self.expr(n.orelse))

    def choose(self, cond: Column, a, b):
        if a is None or b is None:
            raise KernelError("a helper returns on some of its paths only")
        if isinstance(a, Vec):
            return Vec([self.choose(cond, x, y) for x, y in zip(a, b, strict=True)])
        if a.kind == b.kind == "b":
            return Value(F.when(cond, a.c).otherwise(b.c), "b")
        a, b = _num(a), _num(b)
        kind = "i" if a.kind == b.kind == "i" else "f"
        up = (lambda v: v.c.cast("double")) if kind == "f" else (lambda v: v.c)
        return Value(F.when(cond, up(a)).otherwise(up(b)), kind)

    def on_Attribute(self, n):
        if isinstance(n.value, ast.Name) and n.value.id in self.args and not isinstance(self.args[n.value.id], (int, float)):
            v = getattr(self.args[n.value.id], n.attr)  # a template object's scalar
            return _const(v) if isinstance(v, (int, float)) else v
        raise KernelError(f"attribute {n.attr}")

    def on_Subscript(self, n):
        if isinstance(n.value, ast.Attribute) and n.value.attr == "shape":
            return _const(int(self.shape(n.value.value.id)[n.slice.value]))
        if isinstance(n.value, ast.Name) and n.value.id in self.fields:
            return self.load(n.value.id, n.slice)
        v = self.expr(n.value)
        if isinstance(v, Vec):
            k = self.expr(n.slice)
            if k.const is None:
                return Value(F.get(F.array(*[_num(x).c for x in v]), k.c.cast("int")), v[0].kind)
            return v[k.const]
        raise KernelError("subscript")

    def index(self, name: str, s: ast.AST) -> Column:
        if isinstance(s, ast.Constant) and s.value is None:
            return F.lit(0).cast("bigint")
        subs = s.elts if isinstance(s, ast.Tuple) else [s]
        vals = [self.expr(x) for x in subs]
        out = vals[0].c.cast("bigint") if vals[0].kind == "i" else vals[0].c.try_cast("bigint")
        if len(vals) > 1:
            shape = self.shape(name) if self.fields[name] is not None else tuple(self.domain)
            for v, d in zip(vals[1:], shape[1:], strict=True):
                out = out * int(d) + v.c.cast("bigint")
        return out

    def load(self, name: str, s: ast.AST) -> Any:
        """A gather: a left join of the working frame to the field on the index.

        Loads of one text whose names have kept their values share a join. What this iteration has stored at the index is seen.
        """
        if any(f == name and how != "last" for f, *_, how in self.stores):
            raise KernelError(f"{name} is loaded after an atomic update")
        names = [n.id for n in ast.walk(s) if isinstance(n, ast.Name)]
        state = [self.env.get(n, self.args.get(n)) for n in names] + [sum(f == n for f, *_ in self.stores) for n in names]
        known = self.loads.setdefault((name, ast.dump(s)), [])
        at, value = next(((at, v) for then, at, v in known if len(then) == len(state) and all(x is y or (isinstance(x, int) and x == y) for x, y in zip(then, state, strict=True))), (None, None))
        if at is None:
            at = self.settle(self.index(name, s), "i")
            value = self.gather(name, at)
            known.append((state, at, value))
        for field, k, v, pred, _ in self.stores:
            if field == name:
                value = self.choose(pred & (k == at), v, value)
        return value

    def gather(self, name: str, at: Column) -> Any:
        f = self.fields[name]
        if f is None:
            if not any(s[0] == name for s in self.stores):
                raise KernelError(f"{name} is read before it is made")
            first = next(s[2] for s in self.stores if s[0] == name)
            none = lambda v: Value(F.lit(None).cast("double" if v.kind == "f" else "bigint"), v.kind)
            return Vec([none(x) for x in first]) if isinstance(first, Vec) else none(first)
        out = f"__v{next(self.fresh)}"
        source = self.frame(name).select(F.col("idx").alias(f"{out}k"), F.col("val").alias(out))
        self.df = self.df.join(source, at == F.col(f"{out}k"), "left").drop(f"{out}k")
        self.trace.append(f"gather {name} -> {out}")
        kind = self.frame(name).schema["val"].dataType
        if isinstance(kind, T.ArrayType):
            size = self.frame(name).select(F.size("val")).first()
            c = "f" if isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else "i"
            return Vec([Value(F.get(F.col(out), F.lit(k)), c) for k in range(size[0] if size else 0)])
        return Value(F.col(out), self.kind_of(name))

    def on_Call(self, n):
        if n.keywords:
            raise KernelError("keyword arguments")
        f = n.func
        if isinstance(f, ast.Attribute) and not (isinstance(f.value, ast.Name) and f.value.id not in self.env and f.value.id not in self.args):
            owner = self.expr(f.value) if not (isinstance(f.value, ast.Name) and f.value.id in self.args) else self.args[f.value.id]
            if isinstance(owner, Vec):
                return self.vector_method(owner, f.attr, [self.expr(a) for a in n.args])
            method = getattr(type(owner), f.attr, None)
            if isinstance(method, Func):
                return self.inline(method, [owner, *[self.expr(a) for a in n.args]])
            if callable(method):  # a plain method whose result is a column
                return Value(getattr(owner, f.attr)(*[self.expr(a).c for a in n.args]), "f")
            raise KernelError(f"method {f.attr}")
        name = f.attr if isinstance(f, ast.Attribute) else f.id
        if name == "len":
            return _const(int(self.shape(n.args[0].id)[0]))
        if name in ("Vector", "vector"):
            return Vec([self.expr(a) for a in n.args[0].elts])
        if name in ("local_array", "local_array_like"):
            of = n.args[0].attr if isinstance(n.args[0], ast.Attribute) else n.args[0].id
            kind = self.kind_of(of) if name == "local_array_like" else "f" if _CASTS[of].kind == "f" else "i"
            return Vec([_const(0.0 if kind == "f" else 0) for _ in range(self.expr(n.args[1]).const)])
        if name in _BLOCKS:
            group = ieee.idiv(self.loop_index, 256)
            from pyspark.sql import Window

            self.df = self.df.withColumn("__blk", group)
            return Value(self.settle(_BLOCKS[name](_num(self.expr(n.args[0])).c).over(Window.partitionBy("__blk")), "b"), "f")
        if name == "thread_id":
            return Value(self.loop_index % 256, "i")
        args = [self.expr(a) for a in n.args]
        if name in _CASTS:
            v, t = _num(args[0]), _CASTS[name]
            c = ty.cast(v.c, t, ty.f64 if v.kind == "f" else None)
            return Value(c.cast("bigint") if t.kind != "f" else c, "f" if t.kind == "f" else "i")
        if name in ieee.MATH:
            vals = [_num(a) for a in args]
            out = ieee.MATH[name](*[v.c for v in vals])
            if name in ("abs", "min", "max") and all(v.kind == "i" for v in vals):
                return Value(F.least(*[v.c for v in vals]) if name == "min" else F.greatest(*[v.c for v in vals]) if name == "max" else out, "i")
            return Value(out.cast("double"), "f")
        if name in _FUNCS:
            return self.inline(_FUNCS[name], args)
        raise KernelError(f"call of {name}")

    def vector_method(self, v: Vec, name: str, args: list) -> Any:
        prod = lambda a, b: [self.binary(ast.Mult, x, y) for x, y in zip(a, b, strict=True)]

        def total(xs):
            out = xs[0]
            for x in xs[1:]:
                out = self.binary(ast.Add, out, x)
            return out

        if name == "dot":
            if len(v) != len(args[0]):
                raise TypeError("vectors of different lengths")
            return total(prod(v, args[0]))
        if name == "norm_sqr":
            return total(prod(v, v))
        if name == "norm":
            return Value(F.sqrt(total(prod(v, v)).c), "f")
        if name == "normalized":
            n = Value(F.sqrt(total(prod(v, v)).c), "f")
            return Vec([self.binary(ast.Div, x, n) for x in v])
        if name == "cross":
            if len(v) != 3 or len(args[0]) != 3:
                raise TypeError("cross needs three components")
            w, m = args[0], lambda a, b: self.binary(ast.Mult, a, b)
            return Vec([self.binary(ast.Sub, m(v[i], w[j]), m(v[j], w[i])) for i, j in ((1, 2), (2, 0), (0, 1))])
        raise KernelError(f"vector method {name}")

    def inline(self, f: Func, args: list):
        """A helper's body with its parameters bound; an early return ends its branch."""
        names = [a.arg for a in f.tree.args.args]
        held, saved_args = self.env, self.args
        self.env = dict(zip(names, args, strict=True))
        self.args = dict(saved_args) | {k: v for k, v in self.env.items() if not isinstance(v, (Value, Vec))}
        try:
            return self.returns(f.tree.body)
        finally:
            self.env, self.args = held, saved_args

    def returns(self, body: list[ast.stmt]):
        """The value that a helper's statements return."""
        for k, s in enumerate(body):
            if isinstance(s, ast.Return):
                if s.value is None:
                    return None
                return Vec([self.expr(e) for e in s.value.elts]) if isinstance(s.value, ast.Tuple) else self.expr(s.value)
            if isinstance(s, ast.If) and any(isinstance(x, ast.Return) for b in (s.body, s.orelse) for y in b for x in ast.walk(y)):
                cond = _bool(self.expr(s.test))
                env = dict(self.env)
                a = self.returns([*s.body, *body[k + 1 :]])
                self.env = env
                b = self.returns([*s.orelse, *body[k + 1 :]])
                return self.choose(cond, a, b)
            self.stmt(s, None)
        return None

    # ---- statements
    def block(self, body: list[ast.stmt], pred: Column | None) -> None:
        for s in body:
            self.stmt(s, pred)

    def stmt(self, s: ast.stmt, pred: Column | None) -> None:
        if isinstance(s, ast.Assign):
            if len(s.targets) > 1:
                raise KernelError("several targets")
            self.assign(s.targets[0], self.tuple_or(s.value), pred)
        elif isinstance(s, ast.AugAssign):
            load = ast.copy_location(ast.parse(ast.unparse(s.target), mode="eval").body, s)
            self.assign(s.target, self.binary(type(s.op), self.expr(load), self.expr(s.value)), pred)
        elif isinstance(s, ast.If):
            cond = self.settle(_bool(self.expr(s.test)), "p")
            no = ~F.coalesce(cond, F.lit(False))
            self.block(s.body, cond if pred is None else pred & cond)
            self.block(s.orelse, no if pred is None else pred & no)
        elif isinstance(s, ast.For):
            self.inner_for(s, pred)
        elif isinstance(s, ast.While):
            self.inner_while(s, pred)
        elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call):
            self.call_stmt(s.value, pred)
        elif isinstance(s, (ast.Pass, ast.Expr)):
            return
        else:
            raise KernelError(f"{type(s).__name__} is not in the kernel language")

    def tuple_or(self, n: ast.AST):
        return [self.expr(e) for e in n.elts] if isinstance(n, ast.Tuple) else self.expr(n)

    def assign(self, t: ast.AST, v, pred: Column | None) -> None:
        if isinstance(t, ast.Tuple):
            for x, y in zip(t.elts, v, strict=True):
                self.assign(x, y, pred)
        elif isinstance(t, ast.Name):
            old = self.env.get(t.id)
            if pred is not None:
                v = v if old is None else self.choose(pred, v, old)
            self.env[t.id] = self.named(v, t.id)
        elif isinstance(t, ast.Subscript) and isinstance(t.value, ast.Name) and t.value.id in self.fields:
            at = self.settle(self.index(t.value.id, t.slice), "k")
            kept = Vec([Value(self.settle(_num(x).c, "s"), _num(x).kind) for x in v]) if isinstance(v, Vec) else Value(self.settle(_num(v).c, "s"), _num(v).kind)
            kept = self.as_stored(t.value.id, kept)
            self.stores.append((t.value.id, at, kept, F.lit(True) if pred is None else self.settle(F.coalesce(pred, F.lit(False)), "q"), "last"))
        elif isinstance(t, ast.Subscript) and isinstance(t.value, ast.Name) and isinstance(self.env.get(t.value.id), Vec):
            k, vec = self.expr(t.slice), Vec(self.env[t.value.id])
            for i in range(len(vec)):
                here = F.lit(i == k.const) if k.const is not None else k.c == i
                if k.const is None or i == k.const:
                    new = self.choose(here, v, vec[i]) if k.const is None else v
                    vec[i] = self.named(new if pred is None else self.choose(pred, new, vec[i]), t.value.id)
            self.env[t.value.id] = vec
        else:
            raise KernelError("assignment target")

    def as_stored(self, name: str, v):
        """A value as an integer field holds it."""
        if isinstance(v, Vec) or self.fields[name] is None or v.kind != "f" or self.kind_of(name) == "f":
            return v
        return Value(v.c.try_cast("bigint"), "i")

    def named(self, v, stem: str):
        if isinstance(v, Vec):
            return Vec([self.named(x, stem) for x in v])
        if not isinstance(v, Value) or v.const is not None:
            return v
        return Value(self.settle(v.c, stem), v.kind)

    def call_stmt(self, n: ast.Call, pred: Column | None) -> None:
        name = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id
        if name in _ATOMICS:
            target = n.args[0].id
            at, v = self.index(target, n.args[1]), _num(self.expr(n.args[2]))
            self.stores.append((target, self.settle(at, "k"), Value(self.settle(v.c, "s"), v.kind), F.lit(True) if pred is None else self.settle(F.coalesce(pred, F.lit(False)), "q"), _ATOMICS[name]))
        elif name in ("print", "barrier"):
            return
        else:
            self.expr(n)

    def range_of(self, n: ast.AST) -> list[Value]:
        if not (isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "range") or n.keywords:
            raise KernelError("only range loops")
        a = [self.expr(x) for x in n.args]
        return [_const(0), a[0], _const(1)] if len(a) == 1 else [*a, _const(1)][:3]

    def inner_for(self, s: ast.For, pred: Column | None) -> None:
        if s.orelse:
            raise KernelError("loop else")
        lo, hi, step = self.range_of(s.iter)
        has_break = any(isinstance(x, (ast.Break, ast.Continue)) for b in s.body for x in ast.walk(b))
        fixed = None not in (lo.const, hi.const, step.const)
        loaded = self.loads_of(s.body)
        stored = self.changes_fields(s)
        if fixed and not has_break and len(range(lo.const, hi.const, step.const)) <= (GATHERED if loaded and not stored else UNROLL):
            for k in range(lo.const, hi.const, step.const):
                self.env[s.target.id] = _const(k)
                self.block(s.body, pred)
            return
        if stored:
            raise KernelError("a store inside a long loop")
        trips = F.greatest(F.lit(0).cast("bigint"), F.ceil((hi.c - lo.c) / step.c).cast("bigint"))
        if not loaded:
            self.fold(s.body, pred, self.numbers(trips), target=s.target.id, start=lo, step=step)
            return
        steps, cols = self.collected(s, trips, lo, step)
        self.fold(s.body, pred, steps, target=s.target.id, start=lo, step=step, loaded=cols)

    def numbers(self, trips: Column) -> Column:
        return F.when(trips > 0, F.sequence(F.lit(0).cast("bigint"), trips - 1)).otherwise(F.array().cast("array<bigint>"))

    def changes_fields(self, s: ast.stmt) -> bool:
        """Whether a statement stores to a field or updates one atomically."""
        subs = (n.value for n in ast.walk(s) if isinstance(n, ast.Subscript) and isinstance(n.ctx, ast.Store))
        calls = (n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id for n in ast.walk(s) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Attribute, ast.Name)))
        return any(isinstance(v, ast.Name) and v.id in self.fields for v in subs) or any(c in _ATOMICS for c in calls)

    def loads_of(self, body: list[ast.stmt]) -> list[ast.Subscript]:
        return [n for b in body for n in ast.walk(b) if isinstance(n, ast.Subscript) and isinstance(n.ctx, ast.Load) and isinstance(n.value, ast.Name) and n.value.id in self.fields]

    def collected(self, s: ast.For, trips: Column, lo: Value, step: Value) -> tuple[Column, dict[int, tuple[str, str]]]:
        """What a loop loads, before it runs: its trips are exploded, each load is a join, and a row's trips are collected in order.

        Gives the array of structs (k, loaded values) and the field and kind of each load by its index's node.
        """
        k = f"__k{next(self.fresh)}"
        trips = self.settle(trips, "n")
        outer, held = self.df, (self.env, self.keys, self.loads)
        self.df = outer.where(trips > 0).withColumn(k, F.explode(F.sequence(F.lit(0).cast("bigint"), trips - 1)))
        self.env, self.keys, self.loads = dict(self.env), [*self.keys, k], {}
        self.env[s.target.id] = Value(self.settle(lo.c + F.col(k) * step.c, s.target.id), "i")
        carried = {n.id for b in s.body for n in ast.walk(b) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store) and n.id in held[0]}
        cols: dict[int, tuple[str, str]] = {}

        def walk(body: list[ast.stmt], sure: bool) -> None:
            for b in body:
                if isinstance(b, (ast.For, ast.While)) and self.loads_of([b]):
                    raise KernelError("a load in a loop inside a long loop")
                whole = isinstance(b, ast.If)
                for n in self.loads_of([ast.Expr(b.test)] if whole else [b]):
                    if carried & {x.id for x in ast.walk(n.slice) if isinstance(x, ast.Name)}:
                        raise KernelError("a load whose index depends on an earlier trip of its loop")
                    v = self.load(n.value.id, n.slice)
                    if isinstance(v, Vec):
                        raise KernelError("a vector load in a long loop")
                    cols[id(n.slice)] = (f"{n.value.id}{len(cols)}", v.kind)
                    self.df = self.df.withColumn(f"{k}_{len(cols) - 1}", v.c)
                if whole:
                    walk(b.body, False)
                    walk(b.orelse, False)
                elif isinstance(b, (ast.Assign, ast.AugAssign)):
                    names = {x.id for t in (b.targets if isinstance(b, ast.Assign) else [b.target]) for x in ast.walk(t) if isinstance(x, ast.Name)}
                    used = {x.id for x in ast.walk(b.value) if isinstance(x, ast.Name)}
                    if sure and not (names | used) & carried and isinstance(b, ast.Assign):
                        self.stmt(b, None)
                    else:
                        carried.update(names)

        walk(s.body, True)
        got = F.struct(F.col(k).alias("k"), *[F.col(f"{k}_{j}").alias(c) for j, (c, _) in enumerate(cols.values())])
        arrays = self.df.groupBy(*held[1]).agg(F.sort_array(F.collect_list(got)).alias(f"{k}_all"))
        self.env, self.keys, self.loads = held
        self.df = outer.join(arrays, held[1], "left")
        return F.coalesce(F.col(f"{k}_all"), F.array().cast(arrays.schema[f"{k}_all"].dataType)), cols

    def inner_while(self, s: ast.While, pred: Column | None) -> None:
        if s.orelse:
            raise KernelError("loop else")
        if self.loads_of([s]) or self.changes_fields(s):
            raise KernelError("a load or store inside a while loop")
        self.fold(s.body, pred, self.numbers(F.lit(-(-self.bound // TRIPS)).cast("bigint")), test=s.test)

    def fold(self, body, pred, steps: Column, target: str | None = None, start: Value | None = None, step: Value | None = None, test: ast.AST | None = None, loaded: dict[int, tuple[str, str]] | None = None) -> None:
        """A loop over locals inside ``aggregate``: the accumulator is a struct of the locals it assigns and a done flag.

        ``steps`` holds the trips' numbers, or structs of these and what they load. With ``test``, each step takes ``TRIPS`` trips
        unless the row is done, so a row that ends early costs few of them, and a trip that repeats is taken as many times at once.
        """
        changed = [n.id for b in body for n in ast.walk(b) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)]
        names = [n for n in dict.fromkeys(changed) if n in self.env]
        kinds = {n: "f" for n in names}
        sub = _Inner(self)
        spark_kind = {"f": "double", "i": "bigint"}
        for n in names:  # integers stay integers if every assignment keeps them so
            kinds[n] = _num(self.env[n]).kind
        for _ in range(3):
            sub.env = dict(self.env) | {n: Value(F.lit(0).cast(spark_kind[kinds[n]]), kinds[n]) for n in names}
            if target:
                sub.env[target] = Value(F.lit(0).cast("bigint"), "i")
            sub.loaded = {i: Value(F.lit(0).cast(spark_kind[kind]), kind) for i, (_, kind) in (loaded or {}).items()}
            sub.run(body)
            kinds = {n: "f" if "f" in (kinds[n], _num(sub.env[n]).kind) else "i" for n in names}
        leaps = test is not None and "f" not in kinds.values() and _Repeated.takes(self, test, body, names)
        init = F.struct(*[_num(self.env[n]).c.cast(spark_kind[kinds[n]]).alias(n) for n in names], F.lit(False).alias("__done"))

        def merge(acc: Column, i: Column) -> Column:
            sub.env = dict(self.env) | {n: Value(acc[n], kinds[n]) for n in names}
            sub.loaded = {at: Value(i[c], kind) for at, (c, kind) in (loaded or {}).items()}
            if target:
                sub.env[target] = Value(start.c + (i if loaded is None else i["k"]) * step.c, "i")
            go = ~acc["__done"]
            if test is not None:
                go = go & F.coalesce(_bool(sub.expr(test)), F.lit(False))
            stop = sub.run(body)
            if leaps:
                after = F.struct(*[_num(sub.env[n]).c.cast("bigint").alias(n) for n in names], F.lit(False).alias("__done"))
                return F.when(acc["__done"], acc).when(go, _bound(after, lambda new: _Repeated.leap(self, test, body, names, acc, new))).otherwise(F.struct(*[acc[n].alias(n) for n in names], F.lit(True).alias("__done")))
            new = F.struct(*[F.when(go, _num(sub.env[n]).c.cast(spark_kind[kinds[n]])).otherwise(acc[n]).alias(n) for n in names], (acc["__done"] | ~go | stop).alias("__done"))
            return F.when(acc["__done"], acc).otherwise(new)

        many = lambda acc, _: F.when(acc["__done"], acc).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(TRIPS)), acc, merge))
        out = self.settle(F.aggregate(steps, init, merge if test is None else many), "loop")
        late = None
        if test is not None:
            sub.env = dict(self.env) | {n: Value(out[n], kinds[n]) for n in names}
            late = ~out["__done"] & F.coalesce(_bool(sub.expr(test)), F.lit(False)) & (F.lit(True) if pred is None else F.coalesce(pred, F.lit(False)))
        for n in names:
            v = Value(out[n] if late is None else F.when(late, F.raise_error(F.lit(f"a while loop goes on after {self.bound} trips; see while_bound")).cast(spark_kind[kinds[n]])).otherwise(out[n]), kinds[n])
            self.env[n] = self.named(v if pred is None else self.choose(pred, v, self.env[n]), n)

    # ---- the whole
    def run(self) -> dict[str, DataFrame]:
        body = [s for s in self.tree.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
        loops = [s for s in body if isinstance(s, ast.For)]
        if len(loops) != 1:
            raise KernelError("a kernel has one top-level loop")
        loop = loops[0]
        self.df = self.spark.range(1)
        for s in body[: body.index(loop)]:
            self.stmt(s, None)
        name = loop.iter.func.attr if isinstance(loop.iter.func, ast.Attribute) else loop.iter.func.id
        if name == "ndrange":
            dims = [self.expr(a).const for a in loop.iter.args]
            n = 1
            for d in dims:
                n *= d
            self.domain, start, step = dims, 0, 1
        else:
            lo, hi, st = self.range_of(loop.iter)
            if None in (lo.const, hi.const, st.const):
                raise KernelError("the domain must be known")
            self.domain, start, step = [hi.const], lo.const, st.const
            n = len(range(lo.const, hi.const, step))
        scalars = {k: v for k, v in self.env.items()}
        self.df = self.spark.range(n).select((F.col("id") * step + start).alias("__idx"))
        self.env = {k: v for k, v in scalars.items() if isinstance(v, Value) and v.const is not None}
        self.loop_index = F.col("__idx")
        if isinstance(loop.target, ast.Tuple):
            for t, c in zip(loop.target.elts, unpack(F.col("__idx"), self.domain), strict=True):
                self.env[t.id] = Value(self.settle(c, t.id), "i")
        else:
            self.env[loop.target.id] = Value(F.col("__idx"), "i")
        self.block(loop.body, None)
        return {f: self.result(f) for f in dict.fromkeys(s[0] for s in self.stores)}

    def result(self, name: str) -> DataFrame:
        own = [(k, s) for k, s in enumerate(self.stores) if s[0] == name]
        hows = {s[4] for _, s in own}
        if len(hows) > 1:
            raise KernelError(f"{name} is both stored and updated atomically")
        how = hows.pop()
        writes = None
        for k, (_, at, val, pred, _) in own:
            val = F.array(*[x.c for x in val]) if isinstance(val, Vec) else val.c
            part = self.df.where(pred).select(at.alias("idx"), val.alias("val"), F.col("__idx").alias("__by"), F.lit(k).alias("__nth"))
            writes = part if writes is None else writes.unionByName(part)
        base = self.fields[name]
        if how == "last":
            new = writes.groupBy("idx").agg(F.max_by("val", F.struct("__by", "__nth")).alias("val"))
        else:
            new = writes.groupBy("idx").agg({"add": F.sum, "min": F.min, "max": F.max}[how]("val").alias("val"))
        if base is None:
            return new
        old = base.df if isinstance(base, Field) else base
        kind = old.schema["val"].dataType
        both = old.join(new.withColumnRenamed("val", "__new").withColumn("__hit", F.lit(True)), "idx", "left")
        merged = {"last": F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("val")), "add": F.col("val") + F.coalesce("__new", F.lit(0)), "min": F.least("val", "__new"), "max": F.greatest("val", "__new")}[how]
        return both.select("idx", merged.cast(kind).alias("val"))


class _Inner(Compiler):
    """A loop body inside ``aggregate``: expressions over the accumulator alone, ``break`` and ``continue`` as flags."""

    def __init__(self, outer: Compiler):
        super().__init__(outer.tree, outer.args, outer.spark, outer.bound)
        self.outer, self.fields = outer, outer.fields
        self.loaded: dict[int, Value] = {}

    def settle(self, value: Column, stem: str) -> Column:
        return value

    def load(self, name, s):
        if id(s) not in self.loaded:
            raise KernelError("a load that is not collected before its loop")
        return self.loaded[id(s)]

    def run(self, body) -> Column:
        self.stop, self.skip = F.lit(False), F.lit(False)
        self.block(body, None)
        return self.stop

    def stmt(self, s, pred):
        live = ~(self.stop | self.skip)
        here = live if pred is None else pred & live
        if isinstance(s, ast.Break):
            self.stop = self.stop | here
        elif isinstance(s, ast.Continue):
            self.skip = self.skip | here
        elif isinstance(s, ast.If):
            cond = F.coalesce(_bool(self.expr(s.test)), F.lit(False))
            self.block(s.body, here & cond)
            self.block(s.orelse, here & ~cond)
        else:
            super().stmt(s, here)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


class _Repeated:
    """How many trips of a while loop repeat the present one, if its steps are sums and products of integers.

    Each value is followed with what it changes by from trip to trip (None: nothing) if the loop's locals go on changing as in this
    trip. While no comparison on the way changes its outcome and every local's change stays the same, all trips are this one, so
    their changes are added at once. Where that is not certain, as in an overflow, values are NULL and the trip is taken alone.
    """

    def __init__(self, outer: Compiler, env: dict[str, tuple[Column, Column | None]]):
        self.outer, self.env = outer, env
        self.limits: list[Column] = []
        self.lines: list[tuple[Column, Column]] = []  # what changes: it may not overflow on the way

    @classmethod
    def takes(cls, outer: Compiler, test: ast.AST, body: list[ast.stmt], names: list[str]) -> bool:
        zero = F.lit(0).cast("bigint")
        try:
            cls(outer, {n: (zero, zero) for n in names}).trip(test, body)
        except KernelError:
            return False
        return True

    @classmethod
    def leap(cls, outer: Compiler, test: ast.AST, body: list[ast.stmt], names: list[str], acc: Column, new: Column) -> Column:
        """The locals after the trip from ``acc`` to ``new`` and all that repeat it."""

        def taken(by: Column) -> Column:
            one = cls(outer, {n: (acc[n], by[n]) for n in names})
            one.trip(test, body)
            same = [F.when(by[n] == (F.lit(0) if one.env[n][1] is None else one.env[n][1]), F.lit(FAR)).otherwise(F.lit(1)) for n in names]

            def ends(times: Column) -> Column:
                to = lambda c, d: F.try_add(c, F.try_multiply(d, times))
                at = {n: to(acc[n], by[n]) for n in names}
                sure = times > 1
                for c in [*at.values(), *[to(*x) for x in one.lines]]:
                    sure = sure & c.isNotNull()
                leapt = F.struct(*[at[n].alias(n) for n in names], F.lit(False).alias("__done"))
                return F.when(sure, leapt).otherwise(new)

            return _bound(F.least(F.lit(FAR), *one.limits, *same), ends)

        return _bound(F.struct(*[F.try_subtract(new[n], acc[n]).alias(n) for n in names]), taken)

    def trip(self, test: ast.AST, body: list[ast.stmt]) -> None:
        self.truth(test, None)
        self.block(body, None)

    def block(self, body: list[ast.stmt], pred: Column | None) -> None:
        for s in body:
            if isinstance(s, ast.Assign) and len(s.targets) == 1:
                self.assign(s.targets[0], [self.line(e) for e in s.value.elts] if isinstance(s.value, ast.Tuple) else self.line(s.value), pred)
            elif isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
                self.assign(s.target, self.line(ast.BinOp(ast.Name(s.target.id, ast.Load()), s.op, s.value)), pred)
            elif isinstance(s, ast.If):
                cond = F.coalesce(self.truth(s.test, pred), F.lit(False))
                self.block(s.body, cond if pred is None else pred & cond)
                self.block(s.orelse, ~cond if pred is None else pred & ~cond)
            elif not isinstance(s, ast.Pass):
                raise KernelError("no linear step")

    def assign(self, t: ast.AST, v, pred: Column | None) -> None:
        if isinstance(t, ast.Tuple) and isinstance(v, list) and len(t.elts) == len(v):
            for x, y in zip(t.elts, v, strict=True):
                self.assign(x, y, pred)
        elif isinstance(t, ast.Name) and isinstance(v, tuple):
            old = self.env.get(t.id) or (self.line(t) if t.id in self.outer.env else None)
            if pred is not None and old is not None:
                by = None if v[1] is None and old[1] is None else F.when(pred, F.lit(0) if v[1] is None else v[1]).otherwise(F.lit(0) if old[1] is None else old[1])
                v = (F.when(pred, v[0]).otherwise(old[0]), by)
            self.env[t.id] = v
        else:
            raise KernelError("no linear step")

    def line(self, n: ast.AST) -> tuple[Column, Column | None]:
        """A value and what it changes by."""
        if isinstance(n, ast.Name) and n.id in self.env:
            return self.env[n.id]
        if isinstance(n, (ast.Constant, ast.Name)):
            v = self.outer.expr(n)
            if not isinstance(v, Value) or v.kind != "i":
                raise KernelError("no integer")
            return v.c.cast("bigint"), None
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return self.sum(F.try_subtract if isinstance(n.op, ast.USub) else F.try_add, (F.lit(0).cast("bigint"), None), self.line(n.operand))
        if isinstance(n, ast.BinOp) and isinstance(n.op, (ast.Add, ast.Sub)):
            return self.sum(F.try_add if isinstance(n.op, ast.Add) else F.try_subtract, self.line(n.left), self.line(n.right))
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Mult):
            (a, da), (b, db) = self.line(n.left), self.line(n.right)
            by = None
            if da is not None and db is not None:  # one factor stays, or it is no line
                by = F.when(db == 0, F.try_multiply(da, b)).when(da == 0, F.try_multiply(a, db))
            elif da is not None or db is not None:
                by = F.try_multiply(da, b) if db is None else F.try_multiply(a, db)
            return self.kept(F.try_multiply(a, b), by)
        raise KernelError("no linear step")

    def sum(self, f: Callable, x: tuple[Column, Column | None], y: tuple[Column, Column | None]) -> tuple[Column, Column | None]:
        zero = F.lit(0).cast("bigint")
        by = None if x[1] is None and y[1] is None else f(zero if x[1] is None else x[1], zero if y[1] is None else y[1])
        return self.kept(f(x[0], y[0]), by)

    def kept(self, c: Column, by: Column | None) -> tuple[Column, Column | None]:
        if by is not None:
            self.lines.append((c, by))
        return c, by

    def truth(self, n: ast.AST, pred: Column | None) -> Column:
        """A condition; its comparisons limit how often the trip repeats, if ``pred`` holds."""
        if isinstance(n, ast.BoolOp):
            parts = [self.truth(v, pred) for v in n.values]
            for p in parts[1:]:
                parts[0] = parts[0] & p if isinstance(n.op, ast.And) else parts[0] | p
            return parts[0]
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return ~self.truth(n.operand, pred)
        if isinstance(n, ast.Constant) and isinstance(n.value, bool):
            return F.lit(n.value)
        if not isinstance(n, ast.Compare):
            raise KernelError("no comparison")
        left, out = self.line(n.left), None
        for op, r in zip(n.ops, n.comparators, strict=True):
            right = self.line(r)
            one = self.compared(op, left, right, pred)
            out, left = one if out is None else out & one, right
        return out

    def compared(self, op: ast.cmpop, x: tuple[Column, Column | None], y: tuple[Column, Column | None], pred: Column | None) -> Column:
        if not isinstance(op, (ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE)):
            raise KernelError("no comparison")
        a, b = (y, x) if isinstance(op, (ast.Gt, ast.LtE)) else (x, y)
        gap, by = self.sum(F.try_subtract, a, b)
        div = lambda p, q: F.call_function("div", p, q)
        if by is not None:
            if isinstance(op, (ast.Eq, ast.NotEq)):  # until the gap closes, or opens
                closes = ((gap > 0) != (by > 0)) & (gap % by == 0)
                trips = F.when(by == 0, F.lit(FAR)).when(gap == 0, F.lit(1)).when(closes, -F.greatest(div(gap, by), F.lit(-FAR))).otherwise(F.lit(FAR))
            else:  # until the gap's sign changes
                down = F.when(by <= 0, F.lit(FAR)).otherwise(F.least(div(F.bitwise_not(gap), by), F.lit(FAR - 1)) + 1)
                up = F.when(by >= 0, F.lit(FAR)).otherwise(F.least(-F.greatest(div(gap, by), F.lit(1 - FAR)), F.lit(FAR - 1)) + 1)
                trips = F.when(gap < 0, down).otherwise(up)
            trips = F.when(gap.isNull() | by.isNull(), F.lit(1)).otherwise(trips)
            self.limits.append(trips if pred is None else F.when(pred, trips).otherwise(F.lit(FAR)))
        if isinstance(op, (ast.Eq, ast.NotEq)):
            return a[0] == b[0] if isinstance(op, ast.Eq) else a[0] != b[0]
        return a[0] < b[0] if isinstance(op, (ast.Lt, ast.Gt)) else a[0] >= b[0]


class Kernel:
    """A compiled-on-call function; returns its stored fields by name."""

    def __init__(self, f: Callable, while_bound: int = WHILE):
        self.name, self.tree, self.bound = f.__name__, _tree(f), while_bound

    def _compiler(self, args: tuple, kw: dict) -> Compiler:
        if kw:
            raise TypeError(f"{self.name} takes positional arguments only")
        names = [a.arg for a in self.tree.args.args]
        if len(args) != len(names):
            raise TypeError(f"{self.name} takes {len(names)} arguments, got {len(args)}")
        spark = SparkSession.getActiveSession()
        return Compiler(self.tree, dict(zip(names, args, strict=True)), spark, self.bound)

    def __call__(self, *args, **kw) -> dict[str, DataFrame]:
        c = self._compiler(args, kw)
        try:
            return c.run()
        except (KernelError, TypeError) as e:
            e.add_note(f"in kernel {self.name}")
            raise


def kernel(f: Callable | None = None, *, while_bound: int = WHILE):
    """Decorator of a kernel; ``while_bound`` is the most steps of a while loop, each a trip or a leap over trips that repeat."""
    if f is None:
        return lambda g: Kernel(g, while_bound)
    return Kernel(f, while_bound)


def data_oriented(cls):
    """Marks a class whose ``@func`` methods kernels inline; attributes of instances are constants."""
    return cls


def inspect(k: Kernel, *args, mode: str = "ir") -> str:
    """``ir``: the kernel's syntax tree; ``source``: the logical plans; ``optimized``: the physical plans."""
    if mode == "ir":
        return ast.dump(k.tree, indent=2)
    if mode not in ("source", "optimized"):
        raise ValueError(f"unknown mode {mode!r}")
    out = []
    for name, df in k(*args).items():
        q = df._jdf.queryExecution()
        out.append(f"== {name} ==\n" + (q.analyzed() if mode == "source" else q.executedPlan()).toString())
    return "\n".join(out)
