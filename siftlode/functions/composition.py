"""Chemical formulas as expressions: amounts, fractions and weighted statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.operators.order import kept

TOKEN = r"([A-Z][a-z]?|[()\[\]{}])([0-9]*\.?[0-9]*)"
#: What stands between the parts of a hydrate or another adduct.
BETWEEN = r"[*\u00b7\u2022\u2219\u22c5]"
#: A charge at the end: ``^2+``, `` 2-``, digits after a square bracket, or signs alone.
CHARGE = r"(?:(?:\^([0-9]*)|\x20+([0-9]*)|(?<=\])([0-9]+))([+-])|([+-]+))$"
#: What elements and some binary compounds are called by custom.
CUSTOMARY = {"O": "O2", "N": "N2", "F": "F2", "Cl": "Cl2", "H": "H2", "LiO": "Li2O2", "NaO": "Na2O2", "KO": "K2O2", "HO": "H2O2", "CsO": "Cs2O2", "RbO": "Rb2O2"}
#: The last two elements are an anion of several atoms if their electronegativities differ by less.
ANION_GAP = 1.65
#: The elements in the order of their atomic numbers.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
#: The noble gases, each the last element of its row.
ROW_ENDS = (2, 10, 18, 36, 54, 86, 118)
PROPERTIES = ("Z", "mass", "X", "row", "group", "mendeleev", "radius")


def _entries(part: Column) -> Column:
    """Symbols and amounts of one part of a formula, repeated ones included; null if it cannot be parsed.

    Tokens are read from the right: a closing bracket pushes its factor and its
    kind, an opening one must be of that kind and pops them, and an element
    counts times the factor on top.
    """
    tokens = F.reverse(F.regexp_extract_all(part, F.lit(TOKEN), F.lit(0)))
    start = F.expr("named_struct('stack', array(cast(1 as double)), 'kinds', array(''), 'ok', true, 'out', cast(array() as array<struct<symbol:string,amount:double>>))")

    def step(state: Column, token: Column) -> Column:
        symbol, number = F.regexp_extract(token, TOKEN, 1), F.regexp_extract(token, TOKEN, 2)
        n = F.when(number == "", 1.0).otherwise(number.try_cast("double"))
        top, kind = F.element_at(state["stack"], -1), F.element_at(state["kinds"], -1)
        closing, opening = symbol.isin(")", "]", "}"), symbol.isin("(", "[", "{")
        popped = lambda x: F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(1)))
        stack = F.when(closing, F.array_append(state["stack"], top * n)).when(opening, popped(state["stack"])).otherwise(state["stack"])
        kinds = F.when(closing, F.array_append(state["kinds"], F.translate(symbol, ")]}", "([{"))).when(opening, popped(state["kinds"])).otherwise(state["kinds"])
        element = ~closing & ~opening
        ok = state["ok"] & n.isNotNull() & (~opening | ((number == "") & (kind == symbol))) & (~element | symbol.isin(*SYMBOLS))
        out = F.when(element, F.array_append(state["out"], F.struct(symbol.alias("symbol"), (n * top).alias("amount")))).otherwise(state["out"])
        return F.struct(stack.alias("stack"), kinds.alias("kinds"), ok.alias("ok"), out.alias("out"))

    done = lambda state: F.when(state["ok"] & (F.size(state["stack"]) == 1) & (F.size(state["out"]) > 0), state["out"])
    return F.when(F.length(F.array_join(tokens, "")) == F.length(part), F.aggregate(tokens, start, step, done))


def charge(formula: Column) -> Column:
    """The charge at the end of a formula, 0 without one: ``^2+`` or a number after a blank or a square bracket, else the number of signs. A number right after an element is its amount: ``Fe2+`` are two atoms with one charge."""
    part = lambda k: F.regexp_extract(formula, CHARGE, k)
    number = F.concat(part(1), part(2), part(3))
    signs = F.concat(part(4), part(5))
    size = F.when(part(5) != "", F.length(part(5))).when(number != "", number.try_cast("int")).otherwise(F.length(signs))
    return F.when(signs.startswith("-"), -size).otherwise(size)


def amounts(formula: Column) -> Column:
    """Element to amount of a formula; null if it cannot be parsed.

    Brackets are round, square or curly, in pairs of a kind, and may be nested.
    Parts of an adduct stand between ``*`` or dots, each with a factor before
    it where there is one (``Li3SbS4*9H2O``). A charge at the end is left out.
    """
    plain = F.regexp_replace(formula, CHARGE, "")
    several = F.size(F.split(plain, BETWEEN)) > 1

    def part(text: Column) -> Column:
        number = F.regexp_extract(text, r"^([0-9]*\.?[0-9]*)", 1)
        factor = F.when(number == "", 1.0).when(several, number.try_cast("double"))
        return F.transform(_entries(F.regexp_replace(text, r"^[0-9]*\.?[0-9]*", "")), lambda e: F.struct(e["symbol"].alias("symbol"), (e["amount"] * factor).alias("amount")))

    def summed(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda x: x["symbol"]))
        of = lambda s: F.aggregate(F.filter(found, lambda x: x["symbol"] == s), F.lit(0.0), lambda a, x: a + x["amount"])
        entries = F.transform(names, lambda s: F.struct(s, of(s)))
        return F.when(F.forall(found, lambda x: x["amount"].isNotNull()), F.map_from_entries(entries))

    #: Each step is given to the next as an element of an array, so it is written once in the plan. Flattening gives null if a part does.
    found = F.flatten(F.transform(F.split(plain, BETWEEN), part))
    return F.get(F.transform(F.array(found), summed), F.lit(0))


def parse_formulas(df: DataFrame, formula_col: str = "formula") -> tuple[DataFrame, DataFrame]:
    """Rows with ``amounts`` and ``elements``, and the rows whose formula cannot be parsed.

    Each distinct formula is parsed once, into a table of its own, so that
    conditions on elements are not pushed into the parse, and joined back.
    """
    distinct = kept(df.select(F.col(formula_col).alias("_f")).distinct().withColumn("amounts", amounts(F.col("_f"))))
    both = df.join(distinct, df[formula_col].eqNullSafe(distinct["_f"]), "left").drop("_f").withColumn("elements", F.array_sort(F.map_keys("amounts")))
    return both.where("amounts IS NOT NULL"), both.where("amounts IS NULL").drop("amounts", "elements")


def amount(of: Column, element: str) -> Column:
    return F.coalesce(F.try_element_at(of, F.lit(element)), F.lit(0.0))


def map_total(of: Column) -> Column:
    return F.aggregate(F.map_values(of), F.lit(0.0), lambda a, x: a + x)


def fractions(of: Column) -> Column:
    """Amounts divided by their sum."""
    whole = map_total(of)
    return F.transform_values(of, lambda k, v: v / whole)


def li_fraction(of: Column) -> Column:
    return amount(of, "Li") / map_total(of)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, however often it is used: it is given as an element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def common_factor(of: Column) -> Column:
    """The greatest common divisor of whole amounts, by Euclid's steps; at least 1.

    A remainder is taken from the nearer multiple, so it is at most half of the
    divisor, and there are no more steps than the divisor has binary digits.
    """

    def gcd(a: Column, b: Column) -> Column:
        steps = F.sequence(F.lit(1), F.length(F.bin(F.least(a, b))))
        start = F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        step = lambda s, _: F.when(s["b"] > 0, F.struct(s["b"].alias("a"), F.least(s["a"] % s["b"], s["b"] - s["a"] % s["b"]).alias("b"))).otherwise(s)
        return F.aggregate(steps, start, step, lambda s: s["a"])

    whole = F.transform(F.map_values(of), lambda x: F.round(x).cast("long"))
    return F.greatest(F.aggregate(whole, F.lit(0).cast("long"), gcd), F.lit(1).cast("long"))


def reduced(of: Column, factor: Column | None = None) -> Column:
    """Amounts divided by their common factor, as entries sorted by element: the key of a reduced formula. ``factor``: a column that holds it, if there is one."""
    return once(common_factor(of) if factor is None else factor, lambda f: F.array_sort(F.map_entries(F.transform_values(of, lambda k, v: v / f))))


def negativities(props: DataFrame) -> Column:
    """Electronegativity by element, as a map of the element dimension's few rows."""
    known = props.where("X IS NOT NULL").select("element", F.col("X").cast("double")).collect()
    return F.create_map(*[F.lit(v) for r in sorted(known) for v in r])


def reduced_formula(of: Column, negativity: Column) -> Column:
    """The text of a reduced formula, such as ``Li10Ge(PS6)2``.

    Whole amounts are divided by their common factor. Elements stand in the
    order of their electronegativities (unknown ones last), ties by symbol. Of
    three elements or more the last two form an anion, in brackets with its own
    factor, if they are close enough and have a common one. Amounts have eight
    decimals at most, and 1 is left out; elements without any amount are left
    out, and an empty map gives an empty text.
    """
    there = F.map_filter(of, lambda k, v: F.abs(v) > 1e-8)
    whole = F.forall(F.map_values(there), lambda v: v == F.round(v))
    number = lambda n: F.when(n == 1, "").when(n == F.round(n), n.cast("decimal(30,0)").cast("string")).otherwise(F.round(n, 8).cast("string"))
    listed = lambda a: F.array_join(F.transform(a, lambda e: F.concat(e["symbol"], number(e["n"]))), "")

    def text(e: Column) -> Column:
        anion = F.slice(e, -2, 2)
        factor = F.when(F.forall(anion, lambda x: x["n"] == F.round(x["n"])), common_factor(F.map_from_entries(F.transform(anion, lambda x: F.struct(x["symbol"], x["n"])))))
        close = F.get(anion, F.lit(1))["x"] - F.get(anion, F.lit(0))["x"] < ANION_GAP

        def chosen(factor: Column) -> Column:
            divided = F.transform(anion, lambda x: F.struct(x["symbol"].alias("symbol"), (x["n"] / factor).alias("n")))
            grouped = F.concat(listed(F.slice(e, 1, F.greatest(F.size(e) - 2, F.lit(0)))), F.lit("("), listed(divided), F.lit(")"), factor.cast("string"))
            return F.when(factor > 1, grouped).otherwise(listed(e))

        return F.when((F.size(e) < 3) | ~close, listed(e)).otherwise(once(factor, chosen))

    factor = F.when(whole & (F.size(there) > 0), common_factor(there)).otherwise(F.lit(1))
    entry = lambda f: lambda e: F.struct(F.coalesce(F.try_element_at(negativity, e["key"]), F.lit(99.0)).alias("x"), e["key"].alias("symbol"), (e["value"] / f).alias("n"))
    ordered = once(factor, lambda f: F.array_sort(F.transform(F.map_entries(there), entry(f))))
    custom = F.create_map(*[F.lit(x) for pair in CUSTOMARY.items() for x in pair])
    return once(once(ordered, text), lambda plain: F.coalesce(F.try_element_at(custom, plain), plain))


def composition_features(df: DataFrame, props: DataFrame, id_col: str = "id", properties: tuple[str, ...] = PROPERTIES) -> DataFrame:
    """``id, n_elements, Li_frac`` and five statistics of each property, weighted by fraction.

    ``df``: ``id`` and ``amounts``; ``props``: ``element`` and the properties, null
    where unknown. Weights are renormalised over the elements that have a
    property; all five are null where none has it. Deviations are taken from
    the mean in a second pass over the few elements of a row, so nothing
    cancels.
    """
    parts = df.select(id_col, F.explode(fractions(F.col("amounts"))).alias("element", "w"))
    known = parts.join(F.broadcast(props.select("element", *properties)), "element", "left")
    gathered = known.groupBy(id_col).agg(F.collect_list(F.struct("element", "w", *properties)).alias("e"))
    out = []
    for p in properties:
        has = F.filter("e", lambda x: x[p].isNotNull())
        value = lambda x: x[p].cast("double")
        weight = F.aggregate(has, F.lit(0.0), lambda a, x: a + x["w"])
        mean = F.aggregate(has, F.lit(0.0), lambda a, x: a + x["w"] * value(x)) / weight
        least, most = F.array_min(F.transform(has, value)), F.array_max(F.transform(has, value))
        spread = F.sqrt(F.aggregate(has, F.lit(0.0), lambda a, x: a + x["w"] * (value(x) - mean) * (value(x) - mean)) / weight)
        some = F.size(has) > 0
        out += [F.when(some, v).alias(f"{p}_{s}") for s, v in (("mean", mean), ("std", spread), ("min", least), ("max", most), ("range", most - least))]
    li = F.aggregate(F.filter("e", lambda x: x["element"] == "Li"), F.lit(0.0), lambda a, x: a + x["w"])
    return gathered.select(id_col, F.size("e").cast("long").alias("n_elements"), li.alias("Li_frac"), *out)
