"""Clauses about entities, built from arrays and structs by Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty() -> Column:
    return F.lit("")


# fixed values
RESTRICTION_VERBS = {"some": "relates to some", "only": "only relates to", "min": "relates to at least", "max": "relates to at most", "exactly": "relates to exactly"}
NUMERIC = ("integer", "int", "float", "double", "decimal", "long", "short", "nonNegativeInteger", "positiveInteger", "negativeInteger")
VERB_STARTS = ("has ", "is ", "was ", "can ", "does ", "did ", "are ")
TEMPORAL = ("born", "died", "birth date", "death date", "date", "founded", "established", "created", "dissolved", "start date", "end date", "year")
DATE = r"^\d{4}(-\d{2}(-\d{2})?)?$|^\d{1,2}/\d{1,2}/\d{2,4}$"


def concat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def quoted(text: Column) -> Column:
    return concat('"', text, '"')


def filled(items: Column) -> Column:
    """Whether an array has elements; null has none."""
    return F.coalesce(F.size(items) > 0, F.lit(False))


def name_list(names: Column) -> Column:
    """Sorted names joined by commas."""
    return F.array_join(F.array_sort(names), ", ")


def quoted_list(items: Column, joint: str = ", ") -> Column:
    return F.array_join(F.transform(items, quoted), joint)


def single_name(names: Column) -> Column:
    return F.array_min(names)


def synonyms_besides(synonyms: Column, own_name: Column) -> Column:
    """Sorted synonyms; none if the only one is the entity's own name."""
    only = (F.size(synonyms) == 1) & (F.get(synonyms, F.lit(0)) == own_name)
    return F.when(F.coalesce(only, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array_sort(synonyms))


def also_known(synonyms: Column) -> Column:
    return F.when(filled(synonyms), concat(", also known as ", quoted_list(synonyms))).otherwise(empty())


def known_parenthetical(synonyms: Column, preferred: Column) -> Column:
    others = F.array_sort(F.filter(synonyms, lambda s: s != preferred))
    return F.when(filled(others), concat(" (also known as ", quoted_list(others), ")")).otherwise(empty())


def siblings_clause(labels: Column, parent: Column) -> Column:
    """Other "P" concepts include "a", "b" and "c". A missing parent is written as None."""
    n = F.size(labels)
    last = quoted(F.try_element_at(labels, F.lit(-1)))
    many = concat(quoted_list(F.slice(labels, F.lit(1), F.greatest(n - 1, F.lit(0)))), " and ", last)
    return F.when(filled(labels), concat('Other "', F.coalesce(parent, F.lit("None")), '" concepts include ', F.when(n == 1, last).otherwise(many), ".")).otherwise(empty())


def domain_range(label: Column, domain: Column, range_: Column, is_data: Column, domain_synonyms: Column | None = None, range_synonyms: Column | None = None) -> Column:
    """The quoted label and how the property connects its domain and range, if it has any; synonyms if they are given."""

    def side(names: Column, synonyms: Column | None) -> Column:
        text = F.when(filled(names), quoted_list(F.array_sort(names))).otherwise("something")
        if synonyms is None:
            return text
        return concat(text, F.when(filled(synonyms), known_parenthetical(synonyms, F.coalesce(F.array_min(names), empty()))).otherwise(empty()))

    d, r = side(domain, domain_synonyms), side(range_, range_synonyms)
    data = concat(F.when(filled(domain), concat(" on ", d)).otherwise(empty()), " which has data values of type ", r)
    object_ = concat(" which connects ", d, " to ", r)
    return concat(quoted(label), F.when(filled(domain) | filled(range_), F.when(F.coalesce(is_data, F.lit(False)), data).otherwise(object_)).otherwise(empty()))


def restrictions_clause(restrictions: Column) -> Column:
    """restrictions: array<struct<restriction_type, property_name, filler_name, cardinality>>."""

    def clause(r: Column) -> Column:
        verb = F.coalesce(*[F.when(r["restriction_type"] == k, v) for k, v in RESTRICTION_VERBS.items()], F.lit("relates to"))
        filler = F.when(F.coalesce(r["filler_name"], empty()) != "", quoted(r["filler_name"])).otherwise("something")
        counted = r["restriction_type"].isin("min", "max", "exactly") & r["cardinality"].isNotNull()
        return concat(verb, F.when(counted, concat(" ", r["cardinality"].cast("string"))).otherwise(empty()), " ", filler, " via ", quoted(r["property_name"]))

    return F.when(filled(restrictions), concat("It ", F.array_join(F.transform(restrictions, clause), " and "), ".")).otherwise(empty())


def signature_clause(as_domain: Column, as_range: Column, most: int = 4) -> Column:
    parts = F.array(*[F.when(filled(x), concat(f"the {what} of ", quoted_list(F.slice(x, 1, most)))) for what, x in (("domain", as_domain), ("range", as_range))])
    text = F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", and as ")
    return F.when(text != "", concat("In its ontology, it appears as ", text, ".")).otherwise(empty())


def characteristics_clause(characteristics: Column, inverse: Column) -> Column:
    parts = F.array(F.when(filled(characteristics), concat("a ", F.array_join(characteristics, " and "), " property")), F.when(F.coalesce(inverse, empty()) != "", concat("the inverse of ", quoted(inverse))))
    text = F.array_join(F.filter(parts, lambda p: p.isNotNull()), " and ")
    return F.when(text != "", concat("It is ", text, ".")).otherwise(empty())


def types_clause(types: Column) -> Column:
    one = concat("which is a ", quoted(F.get(types, F.lit(0))))
    return F.when(F.size(types) == 1, one).when(filled(types), concat("which is ", F.array_join(F.transform(types, lambda t: concat("a ", quoted(t))), " and "))).otherwise(empty())


def levels_text(levels: Column) -> Column:
    """A tab-indented line for each level."""
    return F.array_join(F.transform(levels, lambda name, i: concat("\tLevel ", i.cast("string"), ": ", name)), "\n")


def attribute_clause(properties: Column, most: Column | int) -> Column:
    """is "homeworld" "Tatooine" and is "height" 172: numbers are not quoted."""

    def clause(p: Column) -> Column:
        value = F.when(F.coalesce(p["datatype"], F.lit("string")).isin(*NUMERIC), p["value"]).otherwise(quoted(p["value"]))
        said = F.when(p["value"].isNotNull(), value).when(p["object_label"].isNotNull(), quoted(p["object_label"]))
        return concat("is ", quoted(p["predicate_label"]), " ", said)

    found = F.filter(F.transform(F.slice(properties, 1, most), clause), lambda c: c.isNotNull())
    return F.coalesce(F.array_join(found, " and "), empty())


def predicate_words(label: Column) -> Column:
    """Camel case, underscores and dashes as separate words in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(F.regexp_replace(label, "([a-z])([A-Z])", "$1 $2"), "_-", "  "), r"\s+", " ")))


def verbalised(label: Column, value: Column) -> Column:
    """A relative clause: which has ..., who was born on ..., whose ... is ...."""
    words = predicate_words(label)
    verb = F.lit(False)
    for start in VERB_STARTS:
        verb = verb | words.startswith(start)
    dated = words.isin(*TEMPORAL) & F.trim(value).rlike(DATE)
    return (
        F.when(verb, concat("which ", words, " ", quoted(value)))
        .when(dated & words.isin("born", "birth date"), concat("who was born on ", value))
        .when(dated & words.isin("died", "death date"), concat("who died on ", value))
        .when(dated, concat("whose ", words, " is ", value))
        .otherwise(concat("whose ", words, " is ", quoted(value)))
    )


def attribute_clause_words(properties: Column, most: Column | int, joint: str = " and ") -> Column:
    value = lambda p: F.coalesce(F.when(p["value"] != "", p["value"]), p["object_label"])
    found = F.transform(F.slice(properties, 1, most), lambda p: F.when((p["predicate_label"] != "") & (value(p) != ""), verbalised(p["predicate_label"], value(p))))
    return F.coalesce(F.array_join(F.filter(found, lambda c: c.isNotNull()), joint), empty())


PROPERTY = "array<struct<predicate_label:string,predicate_uri:string,value:string,datatype:string,object_uri:string,object_label:string,kind:string>>"


def _ordered(properties: Column) -> Column:
    """By label in lower case, then by all other fields; null fields as empty text."""
    fields = ("predicate_uri", "value", "datatype", "object_uri", "object_label", "kind")
    keyed = F.transform(properties, lambda p: F.struct(F.lower(F.trim(p["predicate_label"])).alias("label"), *[F.coalesce(p[f], empty()).alias(f"k_{f}") for f in fields], p.alias("p")))
    return F.array_sort(keyed)


def _value(p: Column) -> Column:
    return F.lower(F.trim(F.coalesce(p["p"]["value"], p["p"]["object_label"], empty())))


def common_properties(source: Column, target: Column, most: int, shared_only: bool = False, entropies: Column | None = None) -> Column:
    """struct(source, target): the properties chosen for each side, `most` at most.

    Labels that both sides have come first, by falling entropy of their predicates if it is given, then by label; for each,
    the first source value that the target has too, else the first of each side. Unless shared_only, each side is filled
    up with the first values of its other labels.
    """
    s, t = (_ordered(F.coalesce(x, F.array().cast(PROPERTY))) for x in (source, target))
    labels_s, labels_t = (F.array_distinct(F.transform(x, lambda p: p["label"])) for x in (s, t))
    shared = F.array_sort(F.array_intersect(labels_s, labels_t))

    def best(label: Column) -> Column:
        mine, theirs = (F.filter(x, lambda p: p["label"] == label) for x in (s, t))
        same = F.get(F.filter(mine, lambda p: (_value(p) != "") & F.exists(theirs, lambda q: _value(q) == _value(p))), F.lit(0))
        match = F.get(F.filter(theirs, lambda q: _value(q) == _value(same)), F.lit(0))
        first, second = F.coalesce(same, F.get(mine, F.lit(0))), F.coalesce(match, F.get(theirs, F.lit(0)))
        weight = F.lit(0.0)
        if entropies is not None:
            weight = -F.greatest(*[F.coalesce(F.try_element_at(entropies, F.coalesce(x["p"]["predicate_uri"], empty())), F.lit(0.0)) for x in (first, second)])
        return F.struct(weight.alias("weight"), label.alias("label"), first["p"].alias("first"), second["p"].alias("second"))

    # only weight and label order the pairs: labels are distinct
    pairs = F.slice(F.array_sort(F.transform(shared, best)), 1, most)

    def side(field: str, every: Column, labels: Column) -> Column:
        chosen = F.transform(pairs, lambda p: p[field])
        if shared_only:
            return chosen
        rest = F.transform(F.array_sort(F.array_except(labels, shared)), lambda label: F.get(F.filter(every, lambda p: p["label"] == label), F.lit(0))["p"])
        return F.slice(F.concat(chosen, rest), 1, most)

    return F.struct(side("first", s, labels_s).alias("source"), side("second", t, labels_t).alias("target"))


def python_text(text: Column) -> Column:
    """A text as a Python literal: in single quotes unless it holds these and no double ones."""
    double = text.contains("'") & ~text.contains('"')
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.when(double, concat('"', escaped, '"')).otherwise(concat("'", F.replace(escaped, F.lit("'"), F.lit("\\'")), "'"))


def python_list(items: Column) -> Column:
    return concat("[", F.array_join(F.transform(items, python_text), ", "), "]")


def python_lists(lists: Column) -> Column:
    return concat("[", F.array_join(F.transform(lists, python_list), ", "), "]")
