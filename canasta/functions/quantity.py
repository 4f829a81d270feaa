"""Package sizes, counts and size ratios read from product names and attributes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canasta.functions.money import fixed
from canasta.functions.text import (COUNTED, LOST_CENTS, LOST_POINT, NUM, UNIT, drop_parens, let, mapping, norm_quantity_text,
                                    norm_text, one_of, repair_decimals)
from canasta.settings import PriceSettings
from canasta.vocabulary import MASS_UNITS, OUNCE_UNITS, UNITS, VOLUME_UNITS

FRACTION_UNITS = "gal|gl|gln|galon|lb|lbs|libra|libras|kg|kilo|l|lt|litro"
TIMES = rf"\b({NUM})\s*x\s*({NUM})\s*({UNIT})\b"
SIZE_TIMES = rf"\b({NUM})\s*({UNIT})\s*x\s*(\d{{1,2}})\b(?!\s*(?:{UNIT})\b)"
FRACTION = rf"\b(?:(\d)\s+)?([1-7])\s*/\s*([2-8])\s*({FRACTION_UNITS})\b"
CASE = rf"\b\d+\s*/\s*({NUM})\s*({UNIT})\b"
SIZE = rf"\b({NUM})\s*({UNIT})\b"
QUANTITY = "struct<total_kg:double,unit_kg:double,note:string>"
COUNT = "struct<n:double,source:string>"


def _factor(unit: Column) -> Column:
    return F.try_element_at(mapping(UNITS), unit).cast("double")


def _part(hit: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(hit, pattern, group)


def _number(hit: Column, pattern: str, group: int) -> Column:
    return _part(hit, pattern, group).try_cast("double")


def _size(total: Column, unit: Column, note: Column) -> Column:
    return F.struct(total.cast("double").alias("total_kg"), unit.cast("double").alias("unit_kg"), note.alias("note"))


def pack_count(text: Column, unit: Column) -> Column:
    """struct(n, source): selling units of a multipack ('6 pack', 'pack de 6', 'six pack'; '6 unidades' for liquids)."""
    numbered = [rf"(?<![/\d])\b(\d{{1,2}})\s*(?:pack|pk|pck|pcks|paq|paquetes?|packs)\b",
                rf"\b(?:pack|paquete|paq|pk)\s*(?:de\s*)?(\d{{1,2}})\b(?!\s*(?:{UNIT})\b)"]
    counted = r"(?<![/\d.])\b(\d{1,2})\s*(?:unidades|unidad|unids|unid|unds|und|uds|un)\b"

    def found(pattern: str, extra: Column | None = None) -> Column:
        n = F.regexp_extract(text, pattern, 1).try_cast("double")
        ok = n.between(2, 48) if extra is None else n.between(2, 48) & extra
        return F.when(ok, F.struct(n.alias("n"), F.regexp_extract(text, pattern, 0).alias("source")))

    six = F.when(text.rlike(r"\bsix\s*pack\b"), F.struct(F.lit(6.0).alias("n"), F.regexp_extract(text, r"\bsix\s*pack\b", 0).alias("source")))
    return F.coalesce(found(numbered[0]), found(numbered[1]), six, found(counted, one_of(unit, [*VOLUME_UNITS, *OUNCE_UNITS])))


def _cascade(s: Column) -> Column:
    """The first reading that applies to repaired quantity text."""
    def times(hit: Column) -> Column:
        n, m, f = _number(hit, TIMES, 1), _number(hit, TIMES, 2), _factor(_part(hit, TIMES, 3))
        code = (_part(hit, TIMES, 1) == _part(hit, TIMES, 2)) & _part(hit, TIMES, 3).isin("kilo", "kilos", "lb", "libra")
        return F.when((hit != "") & ~code, _size(n * m * f, m * f, hit))

    def size_times(hit: Column) -> Column:
        m, f, n = _number(hit, SIZE_TIMES, 1), _factor(_part(hit, SIZE_TIMES, 2)), _number(hit, SIZE_TIMES, 3)
        return F.when(hit != "", _size(n * m * f, m * f, hit))

    def fraction(hit: Column) -> Column:
        whole = F.coalesce(_number(hit, FRACTION, 1), F.lit(0.0))
        a, b = _number(hit, FRACTION, 2), _number(hit, FRACTION, 3)
        kg = (whole + a / b) * _factor(_part(hit, FRACTION, 4))
        return F.when((hit != "") & (a < b), _size(kg, kg, F.concat(F.lit("fraction "), hit)))

    def case(hit: Column) -> Column:
        kg = _number(hit, CASE, 1) * _factor(_part(hit, CASE, 2))
        return F.when(hit != "", _size(kg, kg, F.concat(F.lit("unit size from slash-pack "), hit)))

    def plain(t: Column) -> Column:
        def sized(hit: Column) -> Column:
            unit = _part(hit, SIZE, 2)
            kg = _number(hit, SIZE, 1) * _factor(unit)
            many = let(pack_count(t, unit), lambda p: F.when(p.isNotNull(), _size(
                kg * p["n"], kg, F.concat(p["n"].cast("int").cast("string"), F.lit(" x "), hit, F.lit(" (multipack '"), p["source"], F.lit("')")))))
            return F.when(hit != "", F.coalesce(many, _size(kg, kg, hit)))
        return let(F.regexp_extract(t, SIZE, 0), sized)

    lb = F.lit(UNITS["lb"])
    half, per, bare = r"\b(media|1/2)\s*(libra|lb)\b", r"\bpor\s+(libra|lb)\b", r"\b(kilo|kilogramo)\b"

    def quoted(t: Column, pattern: str, group: int, text: str) -> Column:
        return F.concat(F.lit(text + " from '"), F.regexp_extract(t, pattern, group), F.lit("'"))

    def after(t: Column) -> Column:
        return F.coalesce(
            let(F.regexp_extract(t, SIZE_TIMES, 0), size_times), let(F.regexp_extract(t, FRACTION, 0), fraction),
            let(F.regexp_extract(t, CASE, 0), case), plain(t),
            F.when(t.rlike(half), _size(lb * 0.5, lb * 0.5, quoted(t, half, 0, "implicit half pound"))),
            F.when(t.rlike(per), _size(lb, lb, quoted(t, per, 0, "implicit 1 lb"))),
            F.when(t.rlike(bare), _size(F.lit(1.0), F.lit(1.0), quoted(t, bare, 1, "implicit 1kg"))),
            F.lit(None).cast(QUANTITY))

    # 'NxN kilo' is a grade, not N packs of N kilos: the code is dropped and the rest read on.
    rest = F.regexp_replace(s, rf"^((?s:.*?))\b({NUM})\s*x\s*({NUM})\s*({UNIT})\b", "$1 $4")
    return F.coalesce(let(F.regexp_extract(s, TIMES, 0), times), let(rest, after))


def _repair_note(text: Column) -> Column:
    """What `repair_decimals` changed, or NULL."""
    t = norm_quantity_text(text)
    tenth = rf"(?<![/.\d])\b(\d{{1,2}})\s+([0-9])\s*{LOST_POINT}"

    def last(pattern: str) -> Column:
        return F.element_at(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), -1)

    def told(hit: Column, mark: Column, pattern: str) -> Column:
        fixed_text = F.concat(F.regexp_extract(hit, pattern, 1), mark, F.regexp_extract(hit, pattern, 2), F.regexp_extract(hit, pattern, 3))
        return F.when(mark == "/", F.concat(F.lit("read '"), hit, F.lit("' as case pack "), fixed_text)).otherwise(
            F.concat(F.lit("repaired ambiguous quantity '"), hit, F.lit("' as '"), fixed_text, F.lit("'")))

    point = lambda h: F.when((F.regexp_extract(h, tenth, 2) == "5") | F.regexp_extract(h, tenth, 1).isin("0", "1"), ".").otherwise("/")
    cents = F.when(t.rlike(LOST_CENTS), let(last(LOST_CENTS), lambda h: told(h, F.lit("."), LOST_CENTS)))
    return F.coalesce(cents, F.when(t.rlike(tenth), let(last(tenth), lambda h: told(h, point(h), tenth))))


def parse_quantity(text: Column) -> Column:
    """struct(total_kg, unit_kg, note): the package size in a name; one unit of a multipack is `unit_kg`."""
    read = let(repair_decimals(text), _cascade)
    note = _repair_note(text)
    return let(read, lambda q: _size(q["total_kg"], q["unit_kg"], F.when(
        q["total_kg"].isNull(), "no mass/volume in candidate name").otherwise(F.concat_ws("; ", q["note"], note))))


def _counted(n: Column, source: Column) -> Column:
    return F.struct(n.cast("double").alias("n"), source.alias("source"))


def parse_count(text: Column, loose: bool = False, size: Column | None = None) -> Column:
    """struct(n, source): pieces stated in a name; `loose` also reads retailer shorthand (`size`: the parsed quantity)."""
    dozens, slash, each = r"\b(\d+)\s*docenas?\b", rf"\b\d+\s*/\s*(\d+)\s*(?:{COUNTED})\b", rf"\b(\d+)\s*({COUNTED})\b"

    def integer(t: Column, pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(t, pattern, group).try_cast("bigint")

    def read(s: Column) -> Column:
        n12 = integer(s, dozens)
        usable = F.filter(F.regexp_extract_all(s, F.lit(each), F.lit(0)), lambda m: (integer(m, each) > 0)
                          & ~((integer(m, each) > 1) & F.regexp_extract(m, each, 2).isin("unidad", "pieza", "pza")))
        steps = [
            F.when(n12 > 0, _counted(n12 * 12, F.concat((n12 * 12).cast("string"), F.lit(" units ("), F.regexp_extract(s, dozens, 0), F.lit(")")))),
            F.when(s.rlike(r"\bmedia\s+docena\b"), _counted(F.lit(6), F.lit("6 units (media docena)"))),
            F.when(s.rlike(slash), _counted(integer(s, slash), F.concat(F.regexp_extract(s, slash, 1), F.lit(" units (from "), F.regexp_extract(s, slash, 0), F.lit(")")))),
            let(F.get(usable, F.lit(0)), lambda m: F.when(m.isNotNull(), _counted(integer(m, each), F.concat(integer(m, each).cast("string"), F.lit(" units"))))),
        ]
        if loose:
            tail = F.trim(F.regexp_replace(s, rf"\b{NUM}\s*x\s*{NUM}\b", " "))
            end = r"\b(\d{2,4})$"
            steps += [
                F.when(s.rlike(r"\bdocena\b"), _counted(F.lit(12), F.lit("12 units (docena)"))),
                F.when(s.rlike(r"\b(?:und|unidad|c/u)\b"), _counted(F.lit(1), F.lit("1 unit ('und')"))),
                F.when(tail.rlike(end), _counted(integer(tail, end), F.concat(F.regexp_extract(tail, end, 1), F.lit(" units (trailing number)")))),
                F.when((parse_quantity(text) if size is None else size)["total_kg"].isNotNull(), _counted(F.lit(1), F.lit("1 unit (single item sold by size)"))),
            ]
        return F.coalesce(*steps, _counted(F.lit(None), F.lit("no unit count in name")))

    return let(norm_quantity_text(text), read)


def target_count(name: Column) -> Column:
    """Pieces of a catalogue product: a stated count, else '20x25' as packs of pieces."""
    grid = rf"\b(\d{{1,3}})\s*x\s*(\d{{2,4}})\b(?!\s*(?:{UNIT})\b)(?!\.\d)"

    def product(s: Column) -> Column:
        n = F.regexp_extract(s, grid, 1).try_cast("bigint") * F.regexp_extract(s, grid, 2).try_cast("bigint")
        return F.when(s.rlike(grid), _counted(n, F.concat(n.cast("string"), F.lit(" units ("), F.regexp_extract(s, grid, 0), F.lit(")"))))

    return let(parse_count(name), lambda c: F.when(c["n"] > 0, c).otherwise(F.coalesce(
        let(norm_quantity_text(drop_parens(name)), product), _counted(F.lit(None), F.lit("no unit count in name")))))


def quantity_basis(count: Column, total_kg: Column, category: Column) -> Column:
    """'count' for products defined by pieces: no size in the name, or a non-food article; else 'mass'."""
    return F.when(F.coalesce(count, F.lit(0.0)) == 0, "mass").when(
        total_kg.isNull() | (norm_text(category) == "no alimento"), "count").otherwise("mass")


def sold_by_weight(attrs: Column) -> Column:
    """struct(kg, source) for listings priced per kg (or per a fixed weight), NULL otherwise."""
    def attr(key: str) -> Column:
        return F.element_at(attrs, key)

    per_kg = lambda text: F.struct(F.lit(1.0).alias("kg"), F.lit(text).alias("source"))
    given = F.when(F.coalesce(attr("unit multiplier"), F.lit("")) == "", F.lit(1.0)).otherwise(F.coalesce(attr("unit multiplier").try_cast("double"), F.lit(1.0)))
    sub = F.when(F.coalesce(attr("sub unit"), F.lit("")) == "", F.lit("kg")).otherwise(norm_text(attr("sub unit")))
    size = norm_text(attr("size"))
    short = F.when(given == F.floor(given), given.cast("bigint").cast("string")).otherwise(given.cast("string"))
    return F.coalesce(
        F.when(norm_text(attr("sales_unit_of_measure")).isin("kilogramo", "kilogramos", "kg"), per_kg("sold by weight (price per kg)")),
        F.when((norm_text(attr("unit")) == "kg") & (sub == "kg"), per_kg("sold by weight (price per kg)")),
        F.when((norm_text(attr("measurement unit")) == "kg") & (given > 0), F.struct(given.alias("kg"), F.concat(F.lit("sold by weight (price per "), short, F.lit(" kg)")).alias("source"))),
        F.when(size == "kg", per_kg("sold by weight (price per kg)")),
        F.when(size.rlike(r"^[\d.]+\s*kg$") & F.coalesce(attr("inventory").rlike(r"\.\d*[1-9]"), F.lit(False)), per_kg("sold by weight (price per kg; weighed stock)")))


# Words in attribute names that hint at a count or a size.
COUNT_ATTRIBUTES = ("pack", "size", "count", "unidades")
SIZE_ATTRIBUTES = ("peso", "weight", "contenido", "content", "tamano", "size", "capacidad", "volume", "volumen", "presentacion")


def _from_attributes(attrs: Column, hints: tuple, read) -> Column:
    """The first attribute, by name, that hints at a quantity and holds a positive one."""
    entries = F.array_sort(F.map_entries(attrs))
    fits = F.filter(entries, lambda e: e["key"].rlike("|".join(hints)) & (F.coalesce(e["value"], F.lit("")) != ""))
    values = F.transform(fits, lambda e: F.struct(read(e["value"]).alias("kg"), F.concat(F.lit("attribute "), e["key"], F.lit(": "), e["value"]).alias("source")))
    return F.get(F.filter(values, lambda e: F.coalesce(e["kg"] > 0, F.lit(False))), F.lit(0))


def candidate_quantity(name: Column, attrs: Column, basis: str = "mass", size: Column | None = None) -> Column:
    """struct(kg, source) of a listing: by count, or sold by weight, by its title, by its attributes."""
    if basis == "count":
        title = let(parse_count(name, True, size), lambda c: F.when(c["n"] > 0, F.struct(c["n"].alias("kg"), c["source"].alias("source"))))
        attributes = _from_attributes(attrs, COUNT_ATTRIBUTES, lambda v: parse_count(v)["n"])
        return F.coalesce(title, attributes, F.struct(F.lit(None).cast("double").alias("kg"), F.lit("cannot count units in candidate name").alias("source")))
    whole = let(parse_quantity(name) if size is None else size, lambda q: F.struct(q["total_kg"].alias("kg"), q["note"].alias("source")))
    return let(whole, lambda q: F.coalesce(sold_by_weight(attrs), F.when(q["kg"] > 0, q),
                                           _from_attributes(attrs, SIZE_ATTRIBUTES, lambda v: parse_quantity(v)["total_kg"]), q))


def target_quantity(basis: Column, count: Column, parsed: Column, sheet_kg: Column) -> Column:
    """struct(kg, source) of a catalogue product: pieces, else the size in its name, else the sheet weight."""
    return (F.when(basis == "count", F.struct(count["n"].alias("kg"), F.concat(F.lit("count basis: "), count["source"], F.lit(" (prices are per unit)")).alias("source")))
            .when(parsed["total_kg"].isNotNull(), F.struct(parsed["total_kg"].alias("kg"), parsed["note"].alias("source")))
            .when(sheet_kg > 0, F.struct(sheet_kg.cast("double").alias("kg"), F.lit("Unidad de Peso en KG").alias("source")))
            .otherwise(F.struct(F.lit(None).cast("double").alias("kg"), F.lit("target quantity unavailable").alias("source"))))


def size_ratio(target_kg: Column, candidate_kg: Column) -> Column:
    return F.when((target_kg > 0) & (candidate_kg > 0), F.try_divide(candidate_kg, target_kg))


def quantity_kind(text: Column) -> Column:
    """'volume' when any volume unit is stated, else 'mass' for a mass unit; ounces say neither."""
    units = F.regexp_extract_all(norm_quantity_text(text), F.lit(rf"(?<![a-z])\d+(?:\.\d+)?\s*({UNIT})\b"), F.lit(1))
    return let(units, lambda us: F.when(F.exists(us, lambda u: one_of(u, VOLUME_UNITS)), "volume").when(F.exists(us, lambda u: one_of(u, MASS_UNITS)), "mass"))


def dimensions(text: Column) -> Column:
    """Sorted pair of 'AxB' packaging dimensions without a unit, or NULL."""
    pattern = rf"\b(\d{{1,2}})\s*x\s*(\d{{1,2}})\b(?!\s*(?:{UNIT})\b)(?!\.\d)"
    s = norm_quantity_text(text)
    side = lambda g: F.regexp_extract(s, pattern, g).try_cast("int")
    return F.when(s.rlike(pattern), F.array_sort(F.array(side(1), side(2))))


def quantity_warning(basis: Column, name_kg: Column, sheet_kg: Column, settings: PriceSettings = PriceSettings()) -> Column:
    """struct(warning, note): the sheet weight contradicts the name, or looks like the weight with packaging."""
    usable = (basis != "count") & name_kg.isNotNull() & F.coalesce(sheet_kg > 0, F.lit(False))
    up = F.try_divide(sheet_kg, name_kg)
    packaging = (name_kg > 0) & (up > 1) & (up <= settings.packaging_limit)
    far = F.when(name_kg > 0, F.greatest(name_kg, sheet_kg) / F.least(name_kg, sheet_kg)).otherwise(F.lit(float("inf"))) >= settings.size_warning
    warning = F.concat(F.lit("TARGET SIZE WARNING: name parses to "), fixed(name_kg, 3), F.lit("kg but spreadsheet weight is "), fixed(sheet_kg, 3), F.lit("kg"))
    note = F.concat(F.lit("Spreadsheet weight "), fixed(sheet_kg, 3), F.lit("kg vs "), fixed(name_kg, 3), F.lit("kg in the name (probably includes packaging; the name is used)"))
    return F.struct(F.when(usable & far & ~packaging, warning).otherwise("").alias("warning"),
                    F.when(usable & packaging & (up >= settings.size_warning), note).otherwise("").alias("note"))
