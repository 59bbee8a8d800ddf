"""Question templates: each is a function of a source and a target struct column that gives the question's text.

Fields of the structs, all nullable: classes have names, all_names, synonyms (arrays), own_name, parent, parent_names,
child_names (arrays of arrays), levels (names of the class and of its ancestors by level), level_synonyms (the same for
synonyms), siblings, restrictions, as_domain, as_range; properties have names, own_name, synonyms, domain, range,
domain_synonyms, range_synonyms, is_data, characteristics, inverse; instances have names, uri, types, data, object.

The wording of the questions is fixed: recorded answers belong to these very texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.text import concat, quoted

# fixed values
INSTRUCTIONS = {
    ("true_false", "structured"): 'Respond with a JSON object: {"answer": true} or {"answer": false}.',
    ("true_false", "plain"): 'Respond with "True" or "False".',
    ("yes_no", "structured"): 'Respond with a JSON object: {"answer": "Yes"} or {"answer": "No"}.',
    ("yes_no", "plain"): 'Respond with "Yes" or "No".',
}
SAME_THING = "Do they mean the same thing?"
SAME_RELATION = "Do these properties represent the same relationship?"
SAME_ENTITY = "Do these refer to the same entity?"
BOTH_TRUE = "\nFor these to be the same concept, BOTH of the following must be true:"


@dataclass(frozen=True)
class Context:
    """What a question needs besides its entities."""

    answer_format: str = "true_false"
    response_mode: str = "structured"
    domain: str | None = None
    attributes: Callable[[Column, int], Column] = X.attribute_clause
    most_properties: int = 3
    entropies: Column | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if (self.answer_format, self.response_mode) not in INSTRUCTIONS:
            raise ValueError(f"unknown answer format {self.answer_format} or response mode {self.response_mode}")

    @property
    def instruction(self) -> str:
        return INSTRUCTIONS[self.answer_format, self.response_mode]

    @property
    def preamble(self) -> str:
        return f"We have two entities from different {self.domain} ontologies." if self.domain else "We have two entities from different ontologies."

    @property
    def padded_domain(self) -> str:
        return f" {self.domain} " if self.domain else " "


Template = Callable[[Column, Column, Context], Column]


@dataclass(frozen=True)
class Spec:
    build: Template
    kind: str
    bidirectional: bool
    siblings: bool


REGISTRY: dict[str, Spec] = {}


def register(name: str, kind: str = "CLS", bidirectional: bool = False, siblings: bool = False) -> Callable[[Template], Template]:
    """Adds a template under a name; this is the place to plug in others."""

    def add(build: Template) -> Template:
        REGISTRY[name] = Spec(build, kind, bidirectional, siblings)
        return build

    return add


def question(name: str, source: Column, target: Column, context: Context | None = None) -> Column:
    return REGISTRY[name].build(source, target, context or Context())


def lines(*parts: Column | str) -> Column:
    """Parts that are lists of Columns are joined as they are."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _both(make: Callable[[Column], Column], source: Column, target: Column) -> tuple[Column, Column]:
    return make(source), make(target)


# ---- classes

def _name(e: Column) -> Column:
    return X.name_list(e["names"])


def _synonyms(e: Column) -> Column:
    return X.also_known(X.synonyms_besides(e["synonyms"], e["own_name"]))


def _has_parent(e: Column) -> Column:
    return F.coalesce((e["parent"] != "") & (e["parent"] != "Thing"), F.lit(False))


def _category(e: Column) -> Column:
    return F.when(_has_parent(e), concat(", which falls under the category ", quoted(e["parent"]))).otherwise(X.empty())


def _and_a(e: Column, even_thing: bool) -> Column:
    given = F.coalesce(e["parent"] != "", F.lit(False)) if even_thing else _has_parent(e)
    return F.when(given, concat(" and a ", quoted(e["parent"]))).otherwise(X.empty())


def _siblings(e: Column) -> Column:
    return F.when(X.filled(e["siblings"]), concat(" ", X.siblings_clause(e["siblings"], e["parent"]))).otherwise(X.empty())


def _described(*clauses: Callable[[Column], Column], dot: int | None = None) -> Callable[[Column], Column]:
    """The quoted names and clauses; a full stop stands before clause number `dot`, or at the end."""

    def make(e: Column) -> Column:
        parts = [quoted(_name(e)), *[c(e) for c in clauses]]
        parts.insert(len(parts) if dot is None else dot + 1, F.lit("."))
        return concat(*parts)

    return make


def _two(make: Callable[[Column], Column], s: Column, t: Column, first: str = "The first one is ", second: str = "The second one is ") -> list[Column]:
    return [concat(first, make(s)), concat(second, make(t))]


def _legacy(head: str, fields: list[tuple[str, Callable[[Column], Column]]], end: str, bold: bool = False) -> Template:
    """The oldest form: an indented block with lists of names."""
    mark = "**" if bold else ""

    def build(s: Column, t: Column, c: Context) -> Column:
        out: list[Column | str] = [*(["**Task Description:**"] if bold else []), head, ""]
        for number, what, e in ((1, "Source Entity", s), (2, "Target Entity", t)):
            out.append(f"{number}. {mark}{what}:{mark}")
            out += [concat(f"{mark}{label}:{mark} ", value(e)) for label, value in fields]
            out.append("")
        out.append(end)
        text = []
        for part in out:
            text.append(F.lit("    " + part if part else "") if isinstance(part, str) else concat("    ", part))
        return F.trim(F.concat_ws("\n", *text))

    return build


_ALL = ("All Entity names", lambda e: X.python_list(F.array_sort(e["all_names"])))
_PREFERRED = ("All Entity names", lambda e: X.python_list(F.array_sort(e["names"])))
_PARENTS = ("Parent Entity Namings", lambda e: X.python_lists(e["parent_names"]))
_CHILDREN = ("Child Entity Namings", lambda e: X.python_lists(e["child_names"]))
_GIVEN = "Given two entities from different ontologies with their names{}, determine if these concepts are the same:"
_TF = "Response with True or False"
for _label, _extra, _fields, _end, _bold in (
    ("all_data_dummy", ", parent relationships, and child relationships", [_PREFERRED, _PARENTS, _CHILDREN], 'Write "Yes" if the entities refer to the same concepts, and "No" otherwise.', True),
    ("only_names", "", [_ALL], _TF, False),
    ("with_hierarchy", ", parent relationships, and child relationships", [_ALL, _PARENTS, _CHILDREN], _TF, False),
    ("only_with_parents", " and parent relationships", [_ALL, _PARENTS], _TF, False),
    ("only_with_children", " and child relationships", [_ALL, _CHILDREN], _TF, False),
):
    register(_label)(_legacy(_GIVEN.format(_extra), _fields, _end, _bold))


def _parent_or_none(e: Column) -> Column:
    return F.coalesce(e["parent"], F.lit("None"))


@register("one_level_of_parents_structured")
def _(s: Column, t: Column, c: Context) -> Column:
    out: list[Column | str] = [f"Analyze the following entities, each originating from a distinct{c.padded_domain}ontology.", "Your task is to assess whether they represent the **same ontological concept**, considering both their semantic meaning and hierarchical position."]
    for label, e in (("1. Source", s), ("2. Target", t)):
        out += [concat(f"\n{label} entity: ", quoted(_name(e))), concat("\t- Direct ontological parent: ", _parent_or_none(e))]
    return lines(*out, f"\nAre these entities **ontologically equivalent** within their respective ontologies? {c.instruction}")


@register("two_levels_of_parents_structured")
def _(s: Column, t: Column, c: Context) -> Column:
    out: list[Column | str] = [f"Analyze the following entities, each originating from a distinct{c.padded_domain}ontology.", "Each is represented by its **ontological lineage**, capturing its hierarchical placement from the most general to the most specific level."]
    out += [concat(f"\n{label} entity ontological lineage:\n", X.levels_text(e["levels"])) for label, e in (("1. Source", s), ("2. Target", t))]
    return lines(*out, f"\nBased on their **ontological positioning, hierarchical relationships, and semantic alignment**, do these entities represent the **same ontological concept**? {c.instruction}")


@register("one_level_of_parents")
def _(s: Column, t: Column, c: Context) -> Column:
    def one(e: Column) -> Column:
        return concat(quoted(_name(e)), F.when(F.coalesce(e["parent"], X.empty()) != "", concat(", which belongs to the broader category ", quoted(e["parent"]))).otherwise(X.empty()))

    return lines(c.preamble, *_two(one, s, t), f"\n{SAME_THING} {c.instruction}")


@register("two_levels_of_parents")
def _(s: Column, t: Column, c: Context) -> Column:
    def one(e: Column) -> Column:
        more = [F.when(F.size(e["levels"]) > i, concat(said, quoted(F.get(e["levels"], F.lit(i))))).otherwise(X.empty()) for i, said in ((1, ", which belongs to the broader category "), (2, ", under the even broader category "))]
        return concat(quoted(F.get(e["levels"], F.lit(0))), *more)

    return lines(c.preamble, *_two(one, s, t), f"\n{SAME_THING} {c.instruction}")


@register("one_level_of_parents_and_synonyms")
def _(s: Column, t: Column, c: Context) -> Column:
    return lines(c.preamble, *_two(_described(_synonyms, _category), s, t), f"\n{SAME_THING} {c.instruction}")


@register("eacl_direct_entity_with_synonyms")
def _(s: Column, t: Column, c: Context) -> Column:
    def category(e: Column) -> Column:
        return concat(", which falls under the category ", quoted(_parent_or_none(e)))

    return lines("We have two entities from different biomedical ontologies.", *_two(_described(_synonyms, category), s, t), f'\n{SAME_THING} Respond with "True" or "False".')


@register("two_levels_of_parents_and_synonyms")
def _(s: Column, t: Column, c: Context) -> Column:
    def one(e: Column) -> Column:
        levels, known = e["levels"], e["level_synonyms"]
        name = concat(quoted(F.get(levels, F.lit(0))), X.also_known(F.array_sort(F.get(known, F.lit(0)))))

        def broader(level: Column, i: Column) -> Column:
            own = F.get(known, i + 1)
            said = F.when(i == 0, "belongs to broader category ").otherwise("under the even broader category ")
            return concat(said, quoted(level), F.when(X.filled(own), concat(" (also known as ", X.quoted_list(F.array_sort(own)), ")")).otherwise(X.empty()))

        return concat(F.concat_ws(", ", F.array(name), F.transform(F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))), broader)), ".")

    return lines(c.preamble, *_two(one, s, t), f"\n{SAME_THING} {c.instruction}")


@register("synonyms_only")
def _(s: Column, t: Column, c: Context) -> Column:
    return lines("We have two entities from different ontologies.", *_two(_described(_synonyms), s, t), f"\n{SAME_THING} {c.instruction}")


def _subsumed(described: Callable[[Column], Column], source: Callable[[Column], Column], target: Callable[[Column], Column], asks: tuple[str, str], end: str) -> Template:
    """A question whether one entity's instances are the other's."""

    def build(s: Column, t: Column, c: Context) -> Column:
        ask = concat(f"\n{asks[0]} a ", quoted(_name(s)), source(s), f"{asks[1]} a ", quoted(_name(t)), target(t), end)
        return lines(c.preamble, *_two(described, s, t), ask, f"\n{c.instruction}")

    return build


def _nothing(e: Column) -> Column:
    return X.empty()


def _also(e: Column) -> Column:
    return _and_a(e, False)


def _also_any(e: Column) -> Column:
    return _and_a(e, True)


_IF = ("If something is", ", is it also")
register("sub_labels_only", bidirectional=True)(_subsumed(_described(_synonyms), _nothing, _nothing, _IF, "? "))
register("sub_parents_synonyms", bidirectional=True)(_subsumed(_described(_synonyms, _category), _nothing, _nothing, _IF, "? "))
register("sub_syns_conj_parent", bidirectional=True)(_subsumed(_described(_synonyms, _category), _nothing, _also, _IF, "? "))
register("equiv_test_for_ancestral_disjointness", bidirectional=True)(_subsumed(_described(_synonyms), _also_any, _also_any, ("Can something be", " at the same time as being"), "?"))
register("equiv_with_ancestral_disjointness", bidirectional=True)(_subsumed(_described(_synonyms), _also_any, _also_any, _IF, "?"))


def _two_statements(described: Callable[[Column], Column], extra: Callable[[Column], Column]) -> Template:
    def build(s: Column, t: Column, c: Context) -> Column:
        every = [concat(f"{i}. Every ", quoted(_name(a)), " is also a ", quoted(_name(b)), extra(b), ".") for i, a, b in ((1, s, t), (2, t, s))]
        return lines(c.preamble, *_two(described, s, t), BOTH_TRUE, *every, f"\nAre both statements true? {c.instruction}")

    return build


register("single_subs")(_two_statements(_described(_synonyms), _nothing))
register("single_subs_with_parents")(_two_statements(_described(_synonyms, _category), _nothing))
register("single_subs_with_conj_parent")(_two_statements(_described(_synonyms, _category), _also))


@register("deductive_equiv")
def _(s: Column, t: Column, c: Context) -> Column:
    facts = []
    for e, where in ((s, "(Ontology 1)"), (t, "(Ontology 2)")):
        known = X.synonyms_besides(e["synonyms"], e["own_name"])
        kind = F.when(F.coalesce(e["parent"], X.empty()) != "", concat("- ", quoted(_name(e)), " is a kind of ", quoted(e["parent"]), f" {where}"))
        facts.append(F.coalesce(kind, concat("- ", quoted(_name(e)), f" is a concept in {where[1:-1]}")))
        facts.append(F.when(X.filled(known), concat("- ", quoted(_name(e)), " is also known as ", X.quoted_list(known, " and "), f" {where}")))
    ask = concat("\nGiven these facts, can you conclude that ", quoted(_name(s)), " (Ontology 1) and ", quoted(_name(t)), f" (Ontology 2) refer to the same real-world concept? {c.instruction}")
    return lines(c.preamble, "Consider the following facts:", *facts, ask)


@register("falsification_equiv", siblings=True)
def _(s: Column, t: Column, c: Context) -> Column:
    p, q = _parent_or_none(s), _parent_or_none(t)
    first = concat('\nFirst consider: could something classified as a "', p, '" in one ontology plausibly also be classified as a "', q, '" in another? If the categories suggest entirely different domains, the concepts are unlikely to match. If the categories are compatible or overlapping, the concepts may well match.')
    ask = concat("\nDo ", quoted(_name(s)), ' (a "', p, '") and ', quoted(_name(t)), ' (a "', q, f'") refer to the same concept? {c.instruction}')
    return lines(c.preamble, *_two(_described(_synonyms, _category, _siblings, dot=2), s, t), first, ask)


@register("equiv_parents_siblings", siblings=True)
def _(s: Column, t: Column, c: Context) -> Column:
    return lines(c.preamble, *_two(_described(_category, _siblings, dot=1), s, t), f"\n{SAME_THING} {c.instruction}")


@register("equiv_parents_synonyms_siblings", siblings=True)
def _(s: Column, t: Column, c: Context) -> Column:
    return lines(c.preamble, *_two(_described(_synonyms, _category, _siblings, dot=2), s, t), f"\n{SAME_THING} {c.instruction}")


def _spaced(clause: Column) -> Column:
    return F.when(clause != "", concat(" ", clause)).otherwise(X.empty())


@register("class_with_restrictions")
def _(s: Column, t: Column, c: Context) -> Column:
    make = _described(_synonyms, lambda e: _spaced(X.restrictions_clause(e["restrictions"])), dot=1)
    return lines(c.preamble, *_two(make, s, t), f"{SAME_THING} {c.instruction}")


@register("class_role_signature")
def _(s: Column, t: Column, c: Context) -> Column:
    make = _described(_synonyms, lambda e: _spaced(X.signature_clause(e["as_domain"], e["as_range"])), dot=1)
    return lines(c.preamble, *_two(make, s, t), f"{SAME_THING} {c.instruction}")


# ---- properties

def _label(e: Column) -> Column:
    return F.coalesce(F.array_min(e["names"]), e["own_name"])


def _properties(make: Callable[[Column], Column], end: str = ".") -> Template:
    def build(s: Column, t: Column, c: Context) -> Column:
        return lines(c.preamble, concat("The first property is ", make(s), end), concat("The second property is ", make(t), end), f"{SAME_RELATION} {c.instruction}")

    return build


def _connected(e: Column) -> Column:
    return X.domain_range(_label(e), e["domain"], e["range"], e["is_data"])


def _connected_with_synonyms(e: Column) -> Column:
    whole = X.domain_range(_label(e), e["domain"], e["range"], e["is_data"], e["domain_synonyms"], e["range_synonyms"])
    return concat(quoted(_label(e)), X.known_parenthetical(e["synonyms"], _label(e)), F.substring(whole, F.length(quoted(_label(e))) + 1, F.length(whole)))


register("prop_labels_only", "OPROP")(_properties(lambda e: quoted(_label(e))))
register("prop_domain_range", "OPROP")(_properties(_connected))
register("prop_domain_range_synonyms", "OPROP")(_properties(_connected_with_synonyms, ""))
register("prop_with_inverse_and_chars", "OPROP")(_properties(lambda e: concat(_connected(e), ".", _spaced(X.characteristics_clause(e["characteristics"], e["inverse"]))), ""))


# ---- instances

def _instance(e: Column) -> Column:
    return quoted(F.coalesce(F.array_min(e["names"]), e["uri"]))


def _typed(e: Column) -> Column:
    clause = X.types_clause(e["types"])
    return concat(_instance(e), F.when(clause != "", concat(", ", clause)).otherwise(X.empty()))


def _entities(c: Context, first: Column, second: Column, end: str = ".") -> Column:
    return lines(c.preamble, concat("The first is ", first, "."), concat("The second is ", second, end), f"{SAME_ENTITY} {c.instruction}")


@register("inst_labels_only", "INST")
def _(s: Column, t: Column, c: Context) -> Column:
    return _entities(c, _instance(s), _instance(t), "")


@register("inst_labels_with_types", "INST")
def _(s: Column, t: Column, c: Context) -> Column:
    return _entities(c, _typed(s), _typed(t))


def _with_properties(whole: bool, shared_only: bool, by_entropy: bool) -> Template:
    """whole: attributes and relationships apart; else data and object properties together."""

    def build(s: Column, t: Column, c: Context) -> Column:
        entropies = None
        if by_entropy:
            entropies = c.entropies if c.entropies is not None else F.create_map().cast("map<string,double>")
        groups = (("data", " and has attributes: "), ("object", " and has relationships: ")) if whole else ((None, " and "),)
        sides = [_typed(s), _typed(t)]
        for name, said in groups:
            a, b = (F.concat(*[F.coalesce(e[f], F.array().cast(X.PROPERTY)) for f in ((name,) if name else ("data", "object"))]) for e in (s, t))
            chosen = X.common_properties(a, b, c.most_properties, shared_only or by_entropy, entropies)
            for k, side in enumerate(("source", "target")):
                clause = c.attributes(chosen[side], c.most_properties)
                sides[k] = concat(sides[k], F.when(clause != "", concat(said, clause)).otherwise(X.empty()))
        return _entities(c, *sides)

    return build


for _base, _whole in (("inst_types_and_attributes", False), ("inst_full_context", True)):
    register(_base, "INST")(_with_properties(_whole, False, False))
    register(f"{_base}_intersect", "INST")(_with_properties(_whole, True, False))
    register(f"{_base}_entropy", "INST")(_with_properties(_whole, True, True))


# ---- system prompts

# fixed values
SYSTEM = {
    "generic": "You are an expert in ontology matching. You will be asked to determine if two entities from different ontologies are semantically equivalent. ",
    "class_equivalence": "You are assisting in an OWL ontology alignment exercise. You will be presented with a pair of class entities, one from each of two different ontologies. Additional ontological context such as parent categories and synonyms may be provided. You will be asked to decide whether the two classes are semantically equivalent. ",
    "domain_expert": "You are a domain ontology expert. You will be presented with two domain concepts from different ontologies. Additional ontological context such as hierarchical placement and synonyms may be provided. You will be asked to decide whether the two concepts are semantically equivalent. ",
    "domain_expert_equiv_synonyms": "You are a domain ontology expert. You will be presented with two domain concepts from different ontologies, along with their synonyms and hierarchical context. You will be asked to decide whether the two concepts are semantically equivalent. ",
    "class_subsumption": "You are an expert in ontology matching. You will be asked to determine if one class is a subclass of another. ",
    "class_subsumption_mod": "You are an expert in ontology matching and subsumption inference. You will be presented with two classes from different ontologies, along with hierarchical context. You will be asked to decide if one class is a subclass of the other. ",
    "domain_expert_subsumption": "You are a domain ontology expert. You will be asked to determine if one domain concept is a subclass of another. ",
    "conference_class": "You are assisting in an OWL ontology alignment exercise. You will be presented with a pair of class entities from different ontologies describing the domain of academic conferences. Additional ontological context such as parent categories and synonyms may be provided. You will be asked to decide whether the two classes are semantically equivalent. ",
    "property_equivalence": "You are assisting in an ontology alignment exercise. You will be presented with a pair of properties (relationships) from different ontologies. Additional context such as domain and range classes may be provided. You will be asked to decide whether the two properties represent the same relationship. ",
    "instance_equivalence": "You are assisting in an entity resolution exercise across knowledge graphs. You will be presented with a pair of entities, one from each of two different knowledge graphs. Additional context such as entity types, attributes, and relationships may be provided. You will be asked to decide whether the two entities refer to the same real-world entity. ",
    "eacl_intuitive_nl_judgement": "You are helping researchers determine if two biomedical terms from different ontologies refer to the same concept. You'll be provided with a natural-language description, possibly including synonyms and parent categories. Think like a domain expert but explain your judgement intuitively. Be precise",
}
SYSTEM_AS_IT_IS = ("eacl_intuitive_nl_judgement",)
SYSTEM_INSTRUCTIONS = {
    ("true_false", "plain"): 'Give only a one-word binary response: "True" or "False".',
    ("true_false", "structured"): 'Respond with a JSON object containing a single boolean field "answer": {"answer": true} or {"answer": false}.',
    ("yes_no", "plain"): 'Give only a one-word binary response: "Yes" or "No".',
    ("yes_no", "structured"): 'Respond with a JSON object containing a single string field "answer" with value "Yes" or "No": {"answer": "Yes"} or {"answer": "No"}.',
}


def system_prompt(name: str, answer_format: str = "true_false", response_mode: str = "structured") -> str:
    """The system prompt of a name, with the instruction on the answer's form unless it is used as it is."""
    if name not in SYSTEM or (answer_format, response_mode) not in SYSTEM_INSTRUCTIONS:
        raise ValueError(f"no system prompt {name} for {answer_format}, {response_mode}")
    return SYSTEM[name] if name in SYSTEM_AS_IT_IS else SYSTEM[name] + SYSTEM_INSTRUCTIONS[answer_format, response_mode]
