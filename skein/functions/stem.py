"""Porter (1980) stemming as native column expressions.

The stemmer is a fixed list of suffix rules with conditions on the
"measure" m of the stem (the number of vowel-run/consonant-run pairs).
Every condition is one anchored regular expression over the whole word, so a
stage is a single CASE expression that Spark compiles into whole-stage codegen:
no Python runs per word.

Rules are written once against a tiny operator set (``ops``).  ``ColumnOps``
renders them as Spark ``Column`` objects; ``SqlOps`` renders the same rules as
SQL text, which the DuckDB oracle in ``__spark_entry__`` uses to check that
both engines agree.  Each stage becomes its own projection: a stage refers to
the previous word many times, and keeping stages apart stops expressions from
being inlined into each other (Spark's CollapseProject leaves non-cheap
expressions referenced more than once uncollapsed).

Two variants:

* ``nltk=True`` (default) -- the extended Porter stemmer of the pinned
  stemming library's default mode: words of at most two letters are kept,
  ``-ies``/``-ied`` on four-letter words give ``-ie``, step 1c turns ``y`` into
  ``i`` only after a consonant, ``alli``/``fulli``/``logi`` rules in step 2,
  and a two-letter vowel-consonant stem counts as cvc.
* ``nltk=False`` -- the rules of the 1980 paper.

``irregular=True`` adds the library's short list of irregular forms.  It is
consulted on the word as given (case-sensitive), so upper-cased index tokens
never hit it, while lower-cased query tokens do.

Consonant / vowel classes follow the paper: ``a e i o u`` are vowels, ``y`` is
a vowel only after a consonant, every other character (including non-ASCII
letters) is a consonant.  With C1 = one consonant run and V1 = one vowel run
after a consonant, a word splits uniquely into runs, and the patterns below
match those runs exactly (the character classes at each run boundary are
disjoint, so the regex engine cannot re-split a run).
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- run patterns over lower-case words -------------------------------------
C1 = "[^aeiou][^aeiouy]*"            # a consonant run (starts a word or follows a vowel)
V1 = "[aeiouy][aeiou]*"              # a vowel run that follows a consonant
V0 = "(?:[aeiou]|[^aeiou][^aeiouy]*[aeiouy])"   # prefix up to the first vowel
M1 = V0 + "[aeiou]*[^aeiou]"         # prefix with m >= 1
M2 = M1 + "[^aeiouy]*[aeiouy][aeiou]*[^aeiou]"  # prefix with m >= 2

# The class of a letter ``y`` follows from the run of ``y`` it ends: classes
# alternate along the run, from a consonant after a vowel (or at the start)
# and from a vowel after a consonant.  So the end of a word decides, and no
# pattern repeats a group of varying length (the JVM recurses on those).
Y_CONS = "(?:(?:^|[aeiou])y(?:yy)*|[^aeiouy](?:yy)+)"       # ends on a consonant y
Y_VOWEL = "(?:(?:^|[aeiou])(?:yy)+|[^aeiouy]y(?:yy)*)"      # ends on a vowel y, after a consonant
CVC = "(?:(?:[^aeiouy]|" + Y_CONS + ")[aeiou]|" + Y_VOWEL + ")[^aeiouwxy]"
YY_CONS = "(?:(?:^|[aeiou])y(?:yy)+|[^aeiouy](?:yy)+)"      # ends on yy, the last a consonant

# The irregular forms of the stemming library's extended mode
# (stem <- surface forms).
IRREGULAR_FORMS = {
    "sky": ["sky", "skies"],
    "die": ["dying"],
    "lie": ["lying"],
    "tie": ["tying"],
    "news": ["news"],
    "inning": ["innings", "inning"],
    "outing": ["outings", "outing"],
    "canning": ["cannings", "canning"],
    "howe": ["howe"],
    "proceed": ["proceed"],
    "exceed": ["exceed"],
    "succeed": ["succeed"],
}

# Porter (1980) step 2, 3 and 4 suffix rules, in the order the
# rules are tried (the first suffix that matches decides).
STEP2_RULES = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP2_PAPER_BLI = ("abli", "able")           # the paper's form of the bli rule
STEP2_EXTENDED = [("fulli", "ful"), ("logi", "log")]
STEP3_RULES = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEP4_SUFFIXES = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


# ---- renderings of the same small operator set ---------------------------
class ColumnOps:
    """Render rules as Spark Columns."""

    def c(self, name: str) -> Column:
        return F.col(name)

    def lit(self, v):
        return F.lit(v)

    def lower(self, x):
        return F.lower(x)

    def ends(self, x, s: str):
        return x.endswith(s)

    def rx(self, x, pattern: str):
        return x.rlike(pattern)

    def length(self, x):
        return F.length(x)

    def cut(self, x, n: int):
        return x.substr(F.lit(1), F.length(x) - n)

    def cat(self, x, s: str):
        return F.concat(x, F.lit(s))

    def last_two_equal(self, x):
        return F.substring(x, -1, 1) == F.substring(x, -2, 1)

    def eq(self, x, v):
        return x == v

    def le(self, x, v):
        return x <= v

    def gt(self, x, v):
        return x > v

    def ge(self, x, v):
        return x >= v

    def isin(self, x, values):
        return x.isin(list(values))

    def and_(self, *xs):
        out = xs[0]
        for x in xs[1:]:
            out = out & x
        return out

    def or_(self, *xs):
        out = xs[0]
        for x in xs[1:]:
            out = out | x
        return out

    def not_(self, x):
        return ~x

    def case(self, pairs, default):
        expr = None
        for cond, val in pairs:
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        return default if expr is None else expr.otherwise(default)


class SqlOps:
    """Render rules as SQL text (DuckDB dialect) for the oracle."""

    @staticmethod
    def _q(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v)

    def c(self, name):
        return name

    def lit(self, v):
        return self._q(v)

    def lower(self, x):
        return f"lower({x})"

    def ends(self, x, s):
        return f"ends_with({x}, {self._q(s)})"

    def rx(self, x, pattern):
        return f"regexp_matches({x}, {self._q(pattern)})"

    def length(self, x):
        return f"length({x})"

    def cut(self, x, n):
        return f"left({x}, length({x}) - {n})"

    def cat(self, x, s):
        return f"({x} || {self._q(s)})"

    def last_two_equal(self, x):
        return f"(right({x}, 1) = left(right({x}, 2), 1))"

    def eq(self, x, v):
        return f"({x} = {self._q(v)})"

    def le(self, x, v):
        return f"({x} <= {self._q(v)})"

    def gt(self, x, v):
        return f"({x} > {self._q(v)})"

    def ge(self, x, v):
        return f"({x} >= {self._q(v)})"

    def isin(self, x, values):
        return f"({x} IN ({', '.join(self._q(v) for v in values)}))"

    def and_(self, *xs):
        return "(" + " AND ".join(xs) + ")"

    def or_(self, *xs):
        return "(" + " OR ".join(xs) + ")"

    def not_(self, x):
        return f"(NOT {x})"

    def case(self, pairs, default):
        if not pairs:
            return default
        body = " ".join(f"WHEN {c} THEN {v}" for c, v in pairs)
        return f"(CASE {body} ELSE {default} END)"


class PyOps:
    """Render rules as Python functions of a dict of columns."""

    def c(self, name):
        return lambda row: row[name]

    def lit(self, v):
        return lambda row: v

    def lower(self, x):
        return lambda row: x(row).lower()

    def ends(self, x, s):
        def ends(row):
            return x(row).endswith(s)
        ends.of, ends.suffix = x, s
        return ends

    def rx(self, x, pattern):
        search = re.compile(pattern).search
        return lambda row: search(x(row)) is not None

    def length(self, x):
        return lambda row: len(x(row))

    def cut(self, x, n):
        return lambda row: x(row)[:-n]

    def cat(self, x, s):
        return lambda row: x(row) + s

    def last_two_equal(self, x):
        return lambda row: x(row)[-1:] == x(row)[-2:-1]

    def eq(self, x, v):
        return lambda row: x(row) == v

    def le(self, x, v):
        return lambda row: x(row) <= v

    def gt(self, x, v):
        return lambda row: x(row) > v

    def ge(self, x, v):
        return lambda row: x(row) >= v

    def isin(self, x, values):
        some = frozenset(values)
        return lambda row: x(row) in some

    def and_(self, *xs):
        def all_of(row):
            for x in xs:
                if not x(row):
                    return False
            return True
        return all_of

    def or_(self, *xs):
        def any_of(row):
            for x in xs:
                if x(row):
                    return True
            return False
        return any_of

    def not_(self, x):
        return lambda row: not x(row)

    def case(self, pairs, default):
        if len(pairs) > 1 and all(hasattr(cond, "suffix") and cond.of is pairs[0][0].of for cond, _ in pairs):
            # rules by suffix: most words have none of them
            word, suffixes = pairs[0][0].of, tuple(cond.suffix for cond, _ in pairs)
            values = [(cond.suffix, value) for cond, value in pairs]

            def by_suffix(row):
                w = word(row)
                if w.endswith(suffixes):
                    for suffix, value in values:
                        if w.endswith(suffix):
                            return value(row)
                return default(row)
            return by_suffix

        def chosen(row):
            for cond, value in pairs:
                if cond(row):
                    return value(row)
            return default(row)
        return chosen


class SourceOps:
    """Render rules as Python source over variables of a function: what
    ``stemmer`` compiles.  ``patterns`` are the searches that it calls."""

    class Ends(str):
        """A condition on a suffix, for ``case``."""

    def __init__(self):
        self.patterns = {}

    def c(self, name):
        return name

    def lit(self, v):
        return repr(v)

    def lower(self, x):
        return f"{x}.lower()"

    def ends(self, x, s):
        cond = self.Ends(f"{x}.endswith({s!r})")
        cond.of, cond.suffix = x, s
        return cond

    def rx(self, x, pattern):
        name = self.patterns.setdefault(pattern, f"search{len(self.patterns)}")
        return f"({name}({x}) is not None)"

    def length(self, x):
        return f"len({x})"

    def cut(self, x, n):
        return f"{x}[:-{n}]"

    def cat(self, x, s):
        return f"({x} + {s!r})"

    def last_two_equal(self, x):
        return f"({x}[-1:] == {x}[-2:-1])"

    def eq(self, x, v):
        return f"({x} == {v!r})"

    def le(self, x, v):
        return f"({x} <= {v!r})"

    def gt(self, x, v):
        return f"({x} > {v!r})"

    def ge(self, x, v):
        return f"({x} >= {v!r})"

    def isin(self, x, values):
        return f"({x} in {tuple(values)!r})"

    def and_(self, *xs):
        return f"({' and '.join(xs)})"

    def or_(self, *xs):
        return f"({' or '.join(xs)})"

    def not_(self, x):
        return f"(not {x})"

    def case(self, pairs, default):
        body = "".join(f"{v} if {cond} else " for cond, v in pairs) + default
        if len(pairs) > 1 and all(isinstance(cond, self.Ends) and cond.of == pairs[0][0].of for cond, _ in pairs):
            # rules by suffix: most words have none of them
            suffixes = tuple(cond.suffix for cond, _ in pairs)
            return f"(({body}) if {pairs[0][0].of}.endswith({suffixes!r}) else {default})"
        return f"({body})"


# ---- conditions (on the stem = word minus ``suffix``) ------------------------
def _m_gt0(o, w, suffix=""):
    return o.rx(w, "^" + M1 + ".*" + suffix + "$")


def _m_gt1(o, w, suffix=""):
    return o.rx(w, "^" + M2 + ".*" + suffix + "$")


def _has_vowel(o, w, suffix=""):
    return o.rx(w, "^" + V0 + ".*" + suffix + "$")


def _ends_cvc(o, w, suffix, nltk):
    cvc = o.rx(w, CVC + suffix + "$")
    if nltk:
        return o.or_(cvc, o.rx(w, "^[aeiou][^aeiou]" + suffix + "$"))
    return cvc


def _ends_double_consonant(o, w):
    return o.and_(o.ge(o.length(w), 2), o.last_two_equal(w),
                  o.or_(o.rx(w, "[^aeiouy]$"),
                        o.rx(w, YY_CONS + "$")))


def _rule_list(o, w, rules, default=None):
    """First matching suffix decides; a failed condition keeps the word."""
    pairs = []
    for suffix, repl, cond in rules:
        out = o.cat(o.cut(w, len(suffix)), repl) if repl else o.cut(w, len(suffix))
        pairs.append((o.ends(w, suffix), o.case([(cond, out)], w)))
    return o.case(pairs, w if default is None else default)


# ---- stages ----------------------------------------------------------------
def porter_stages(o, word_col: str, nltk: bool = True, irregular: bool = False):
    """List of stages; each stage is a list of (column, expression) pairs that
    reads only columns produced by earlier stages.  The result is in ``__w``."""
    t = o.c(word_col)
    w = o.c("__w")
    r = o.c("__r")
    stages = [[("__w", o.lower(t))]]

    # step 1a
    rules = []
    if nltk:
        rules.append((o.and_(o.ends(w, "ies"), o.eq(o.length(w), 4)),
                      o.cat(o.cut(w, 3), "ie")))
    rules += [
        (o.ends(w, "sses"), o.cut(w, 2)),
        (o.ends(w, "ies"), o.cut(w, 2)),
        (o.ends(w, "ss"), w),
        (o.ends(w, "s"), o.cut(w, 1)),
    ]
    stages.append([("__w", o.case(rules, w))])

    # step 1b: pick the rule (code) once, then rewrite, then tidy the stem
    codes = []
    if nltk:
        codes += [(o.and_(o.ends(w, "ied"), o.eq(o.length(w), 4)), o.lit(1)),
                  (o.ends(w, "ied"), o.lit(2))]
    codes += [
        (o.and_(o.ends(w, "eed"), _m_gt0(o, w, "eed")), o.lit(3)),
        (o.ends(w, "eed"), o.lit(0)),
        (o.and_(o.ends(w, "ed"), _has_vowel(o, w, "ed")), o.lit(5)),
        (o.and_(o.ends(w, "ing"), _has_vowel(o, w, "ing")), o.lit(6)),
    ]
    stages.append([("__r", o.case(codes, o.lit(0)))])
    stages.append([("__w", o.case([
        (o.eq(r, 1), o.cat(o.cut(w, 3), "ie")),
        (o.eq(r, 2), o.cat(o.cut(w, 3), "i")),
        (o.eq(r, 3), o.cut(w, 1)),
        (o.eq(r, 5), o.cut(w, 2)),
        (o.eq(r, 6), o.cut(w, 3)),
    ], w))])
    tidy = o.case([
        (o.ends(w, "at"), o.cat(w, "e")),
        (o.ends(w, "bl"), o.cat(w, "e")),
        (o.ends(w, "iz"), o.cat(w, "e")),
        (_ends_double_consonant(o, w),
         o.case([(o.rx(w, "[lsz]$"), w)], o.cut(w, 1))),
        (o.and_(_m_gt0(o, w), o.not_(_m_gt1(o, w)), _ends_cvc(o, w, "", nltk)),
         o.cat(w, "e")),
    ], w)
    stages.append([("__w", o.case([(o.ge(r, 5), tidy)], w))])

    # step 1c
    if nltk:
        y_to_i = o.and_(o.ends(w, "y"), o.gt(o.length(w), 2),
                        o.rx(w, Y_VOWEL + "$"))
    else:
        y_to_i = o.and_(o.ends(w, "y"), _has_vowel(o, w, "y"))
    stages.append([("__w", o.case([(y_to_i, o.cat(o.cut(w, 1), "i"))], w))])

    # step 2 (the extended mode first folds -alli into -al, then runs step 2)
    if nltk:
        stages.append([("__w", o.case(
            [(o.and_(o.ends(w, "alli"), _m_gt0(o, w, "alli")), o.cut(w, 2))], w))])
    step2 = []
    for suffix, repl in STEP2_RULES:
        if suffix == "bli" and not nltk:
            suffix, repl = STEP2_PAPER_BLI
        step2.append((suffix, repl, _m_gt0(o, w, suffix)))
    if nltk:
        for suffix, repl in STEP2_EXTENDED:
            # the l of -logi stays with the stem for the measure
            measured = "ogi" if suffix == "logi" else suffix
            step2.append((suffix, repl, _m_gt0(o, w, measured)))
    stages.append([("__w", _rule_list(o, w, step2))])

    # step 3
    stages.append([("__w", _rule_list(
        o, w, [(s, rep, _m_gt0(o, w, s)) for s, rep in STEP3_RULES]))])

    # step 4
    step4 = []
    for s in STEP4_SUFFIXES:
        cond = _m_gt1(o, w, s)
        if s == "ion":
            cond = o.and_(cond, o.rx(w, "[st]ion$"))
        step4.append((s, "", cond))
    stages.append([("__w", _rule_list(o, w, step4))])

    # step 5a, 5b
    stages.append([("__w", o.case([(o.ends(w, "e"), o.case([
        (_m_gt1(o, w, "e"), o.cut(w, 1)),
        (o.and_(_m_gt0(o, w, "e"), o.not_(_ends_cvc(o, w, "e", nltk))), o.cut(w, 1)),
    ], w))], w))])
    stages.append([("__w", o.case(
        [(o.and_(o.ends(w, "ll"), _m_gt1(o, w, "l")), o.cut(w, 1))], w))])

    # words the extended mode leaves alone
    final = []
    if nltk and irregular:
        for stem, forms in IRREGULAR_FORMS.items():
            final.append((o.isin(t, forms), o.lit(stem)))
    if nltk:
        final.append((o.le(o.length(t), 2), o.lower(t)))
    if final:
        stages.append([("__w", o.case(final, w))])
    return stages


def with_stem(df: DataFrame, word_col: str, out_col: str = "term",
              nltk: bool = True, irregular: bool = False) -> DataFrame:
    """Add ``out_col`` = Porter stem of ``word_col`` (one projection per stage)."""
    o = ColumnOps()
    cur = df
    for stage in porter_stages(o, word_col, nltk=nltk, irregular=irregular):
        cur = cur.withColumns(dict(stage))
    # explode(array(stem)) is a one-row Generate that ends the chain of stage
    # projections: Catalyst does not push a filter on a generated column any
    # further, so a later predicate on the stem (say the isnotnull a join
    # infers) is not inlined stage into stage, which would grow exponentially.
    keep = [c for c in df.columns if c != out_col]
    return cur.select(*keep, F.explode(F.array(F.col("__w"))).alias(out_col))


#: What a word must end with for any rule to change it.
SUFFIXES = tuple(sorted({"s", "ed", "ing", "y", "alli", "e", "ll", STEP2_PAPER_BLI[0], *STEP4_SUFFIXES,
                         *(rule[0] for rule in [*STEP2_RULES, *STEP2_EXTENDED, *STEP3_RULES])}))


@functools.cache
def stemmer(nltk: bool = True, irregular: bool = False):
    """The same rules as a function of one word."""
    o = SourceOps()
    stages = porter_stages(o, "word", nltk, irregular)
    lines = ["def rules(word):", *[f" {name} = {rule}" for parts in stages for name, rule in parts], " return __w"]
    names = {name: re.compile(pattern).search for pattern, name in o.patterns.items()}
    exec("\n".join(lines), names)
    rules = names["rules"]
    listed = frozenset(form for forms in IRREGULAR_FORMS.values() for form in forms)

    def stem(word: str) -> str:
        lower = word.lower()
        if not lower.endswith(SUFFIXES) and word not in listed:
            return lower
        return rules(word)
    return stem


def stem_sql(source_sql: str, word_col: str, nltk: bool = True,
             irregular: bool = False, out_col: str = "term") -> str:
    """SQL (DuckDB) of the same stemmer: a SELECT over ``source_sql`` adding
    ``out_col``; used by the oracle queries."""
    o = SqlOps()
    sql = f"SELECT * FROM ({source_sql})"
    existing = set()
    for i, stage in enumerate(porter_stages(o, word_col, nltk=nltk, irregular=irregular)):
        parts_new, parts_replace = [], []
        for name, expr in stage:
            (parts_replace if name in existing else parts_new).append(f"{expr} AS {name}")
            existing.add(name)
        head = "SELECT *"
        if parts_replace:
            head += " REPLACE (" + ", ".join(parts_replace) + ")"
        if parts_new:
            head += ", " + ", ".join(parts_new)
        sql = f"{head} FROM ({sql}) AS st{i}"
    cols = "__r, " if "__r" in existing else ""
    return f"SELECT * EXCLUDE ({cols}__w), __w AS {out_col} FROM ({sql}) AS stem_out"
