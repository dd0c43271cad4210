"""What programs consist of."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


class LanguageError(ValueError):
    """A program that is not well-formed, typed or safe."""


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return "_" if self.anonymous else self.name

    @property
    def anonymous(self) -> bool:
        return self.name.startswith("_")


@dataclass(frozen=True)
class Const:
    """kind: number, float64, string, bytes, name, time or duration (both in nanoseconds)."""

    kind: str
    value: object

    def __str__(self) -> str:
        from hornspark.lang.printer import constant

        return constant(self)


@dataclass(frozen=True)
class Call:
    """A function applied to terms; also types, such as fn:List(/number)."""

    name: str
    args: tuple[Term, ...]

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"


Term = Var | Const | Call

#: Bounds of time that stand for no bound, in nanoseconds.
BEGINNING, FOREVER = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Interval:
    start: Term
    end: Term

    def __str__(self) -> str:
        show = lambda t: "_" if isinstance(t, Const) and t.value in (BEGINNING, FOREVER) else str(t)
        return f"@[{show(self.start)}, {show(self.end)}]"


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple[Term, ...]
    interval: Interval | None = None

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))}){self.interval or ''}"

    @property
    def terms(self) -> tuple[Term, ...]:
        """The columns: arguments, then the bounds of validity."""
        return self.args if self.interval is None else (*self.args, self.interval.start, self.interval.end)


@dataclass(frozen=True)
class Not:
    atom: Atom

    def __str__(self) -> str:
        return f"!{self.atom}"


@dataclass(frozen=True)
class Compare:
    """op: =, !=, <, <=, > or >=."""

    op: str
    left: Term
    right: Term

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


Premise = Atom | Not | Compare


@dataclass(frozen=True)
class Step:
    """One statement of a transform: let var = call, or, without a variable, do call."""

    var: str | None
    call: Term

    def __str__(self) -> str:
        return f"let {self.var} = {self.call}" if self.var else f"do {self.call}"


@dataclass(frozen=True)
class Clause:
    head: Atom
    body: tuple[Premise, ...] = ()
    steps: tuple[Step, ...] = ()
    line: int = 0

    def __str__(self) -> str:
        out = str(self.head)
        if self.body:
            out += " :- " + ", ".join(map(str, self.body))
        if self.steps:
            out += " |> " + "; ".join(map(str, self.steps))
        return out + "."

    @property
    def grouped(self) -> bool:
        return bool(self.steps) and self.steps[0].var is None


@dataclass(frozen=True)
class Decl:
    atom: Atom
    temporal: bool = False
    descr: tuple[Atom, ...] = ()
    bounds: tuple[tuple[Term, ...], ...] = ()
    inclusion: tuple[Atom, ...] = ()


@dataclass(frozen=True)
class Unit:
    clauses: tuple[Clause, ...]
    decls: tuple[Decl, ...] = ()
    package: str = ""
    uses: tuple[str, ...] = field(default=())

    def merged(self, other: Unit) -> Unit:
        return replace(self, clauses=self.clauses + other.clauses, decls=self.decls + other.decls, package="")


def variables(x: object) -> list[str]:
    """Names of the variables in a term, premise or interval, each once, in order."""
    out: dict[str, None] = {}

    def walk(t):
        match t:
            case Var(name):
                out[name] = None
            case Call(_, args):
                for a in args:
                    walk(a)
            case Atom():
                for a in t.terms:
                    walk(a)
            case Not(atom):
                walk(atom)
            case Compare(_, left, right):
                walk(left)
                walk(right)
            case tuple() | list():
                for a in t:
                    walk(a)

    walk(x)
    return list(out)
