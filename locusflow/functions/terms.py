"""Conditions on alignments with undefined values, as Columns.

A term is a number, a string or undefined (NULL). Comparing a string with a number is false, and != is no exception to
that but where both are defined. Undefined operands give undefined, but that ``no`` of undefined is true and that
``some`` takes a true side. &, |, ^ and ~ work on whole numbers. A term counts as true if it is a number other than 0 or a
string other than the empty one; rows pass if all of their conditions are true.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions import cigar as cg
from locusflow.operators.reads import FLAGS


class Term:
    """A column of numbers or strings whose operators follow the rules above."""

    __hash__ = None

    def __init__(self, column: Column, text: bool = False):
        self.column, self.text = column if text else column.cast("double"), text

    def number(self) -> Column:
        if self.text:
            raise ValueError("a number is needed, not a string")
        return self.column

    def whole(self) -> Column:
        return self.number().cast("bigint")

    def true(self) -> Column:
        return self.column != "" if self.text else self.column != 0

    def _with(self, other, f: Callable[[Column, Column], Column]) -> Term:
        return Term(f(self.number(), term(other).number()))

    def _bits(self, other, name: str) -> Term:
        return Term(getattr(self.whole(), name)(term(other).whole()))

    def _compared(self, other, f: Callable[[Column, Column], Column]) -> Term:
        other = term(other)
        if self.text != other.text:
            return Term(F.when(self.column.isNotNull() & other.column.isNotNull(), F.lit(False)))
        return Term(f(self.column, other.column))

    def __add__(self, other) -> Term:
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other) -> Term:
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other) -> Term:
        return self._with(other, lambda a, b: a * b)

    def __truediv__(self, other) -> Term:
        return self._with(other, F.try_divide)

    def __mod__(self, other) -> Term:
        n = term(other).whole()
        return Term(F.when(n != 0, self.whole() % F.when(n != 0, n)))

    def __neg__(self) -> Term:
        return Term(-self.number())

    def __and__(self, other) -> Term:
        return self._bits(other, "bitwiseAND")

    def __or__(self, other) -> Term:
        return self._bits(other, "bitwiseOR")

    def __xor__(self, other) -> Term:
        return self._bits(other, "bitwiseXOR")

    def __invert__(self) -> Term:
        return Term(F.bitwise_not(self.whole()))

    def __lt__(self, other) -> Term:
        return self._compared(other, lambda a, b: a < b)

    def __le__(self, other) -> Term:
        return self._compared(other, lambda a, b: a <= b)

    def __gt__(self, other) -> Term:
        return self._compared(other, lambda a, b: a > b)

    def __ge__(self, other) -> Term:
        return self._compared(other, lambda a, b: a >= b)

    def __eq__(self, other) -> Term:
        return self._compared(other, lambda a, b: a == b)

    def __ne__(self, other) -> Term:
        other = term(other)
        if self.text != other.text:
            return Term(F.when(self.column.isNotNull() & other.column.isNotNull(), F.lit(True)))
        return Term(self.column != other.column)

    def matches(self, pattern: str) -> Term:
        if not self.text:
            raise ValueError("a pattern needs a string")
        return Term(F.regexp_like(self.column, F.lit(pattern)))


def term(x) -> Term:
    return x if isinstance(x, Term) else Term(F.lit(x), isinstance(x, str))


def both(a: Term, b: Term) -> Term:
    """Undefined if either side is, even beside a false one."""
    x, y = a.true(), b.true()
    return Term(F.when(x.isNotNull() & y.isNotNull(), x & y))


def some(*terms: Term) -> Term:
    out = terms[0].true()
    for t in terms[1:]:
        out = out | t.true()
    return Term(out)


def no(t: Term) -> Term:
    return Term(F.coalesce(~t.true(), F.lit(True)))


def exists(t: Term) -> Term:
    return Term(t.column.isNotNull())


def default(t: Term, otherwise) -> Term:
    return Term(F.coalesce(t.column, term(otherwise).column), t.text)


def _codes(t: Term) -> Column:
    if not t.text:
        raise ValueError("a string is needed")
    return F.transform(F.split(t.column, ""), lambda c: F.ascii(c))


def length(t: Term) -> Term:
    if not t.text:
        raise ValueError("a string is needed")
    return Term(F.length(t.column))


def least(t: Term) -> Term:
    """The smallest character code."""
    return Term(F.array_min(_codes(t)))


def most(t: Term) -> Term:
    return Term(F.array_max(_codes(t)))


def average(t: Term) -> Term:
    return Term(F.try_divide(F.aggregate(_codes(t), F.lit(0), lambda s, c: s + c).cast("double"), F.length(t.column).cast("double")))


def power(t: Term, exponent) -> Term:
    return t._with(exponent, F.pow)


def _defined(f: Callable[[Column], Column]) -> Callable[[Term], Term]:
    return lambda t: Term(F.when(~F.isnan(f(t.number())), f(t.number())))


root, logarithm, exponential = _defined(F.sqrt), _defined(F.log), _defined(F.exp)

#: name: (column of the reads table, whether it is text)
PLAIN = {
    "qname": ("qname", True), "rname": ("contig", True), "pos": ("pos", False), "mapq": ("mapq", False), "cigar": ("cigar", True), "flag": ("flag", False), "mrname": ("mate_contig", True), "rnext": ("mate_contig", True),
    "mpos": ("mate_pos", False), "pnext": ("mate_pos", False), "tlen": ("tlen", False), "seq": ("seq", True), "qual": ("qual", True), "library": ("library", True),
}
#: name: the value of an alignment's CIGAR blocks
OF_BLOCKS = {
    "ncigar": F.size, "qlen": lambda b: cg.span(b, cg.QUERY), "rlen": lambda b: cg.span(b, cg.REFERENCE), "sclen": lambda b: cg.span(b, "S"), "hclen": lambda b: cg.span(b, "H"),
    "endpos": lambda b: cg.end_of(F.col("pos"), b),
}


class Reads:
    """The terms of a reads table by name, as far as it has their columns; what comes from the CIGAR takes its blocks."""

    def __init__(self, df: DataFrame, blocks: Column):
        self._columns, self._blocks, self.cut = set(df.columns), blocks, False

    def __getattr__(self, name: str) -> Term:
        if name in OF_BLOCKS and "cigar" in self._columns and (name != "endpos" or "pos" in self._columns):
            self.cut = True
            return Term(OF_BLOCKS[name](self._blocks))
        column, text = PLAIN.get(name, (None, False))
        if column not in self._columns:
            raise AttributeError(name)
        return Term(F.col(column), text)

    def has(self, flag: str) -> Term:
        """The bit of a named flag, 0 if it isn't set."""
        return self.flag & FLAGS[flag]

    def tag(self, name: str) -> Term:
        return Term(F.col("tags")[name], True)


def matching(df: DataFrame, *conditions: Callable[[Reads], Term]) -> DataFrame:
    """The rows of a reads table for which all conditions are true. A CIGAR is taken apart once a row, whatever uses it."""

    def held(blocks: Column) -> tuple[Column, bool]:
        reads, out = Reads(df, blocks), F.lit(True)
        for c in conditions:
            out = out & F.coalesce(c(reads).true(), F.lit(False))
        return out, reads.cut

    plain, cut = held(F.array())
    return df.where(F.exists(F.array(cg.blocks(F.col("cigar"))), lambda b: held(b)[0])) if cut else df.where(plain)
