"""Triples (s, p, o, o_is_literal, lang, datatype) and what is asked of them: labels, hierarchies, contexts, entropies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import relations as R
from weftline.operators.retrieval import dot
from weftline.shared import work_dir

# fixed values
RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
TYPE, LABEL, SUBCLASS, DOMAIN, RANGE = f"{RDF}type", f"{RDFS}label", f"{RDFS}subClassOf", f"{RDFS}domain", f"{RDFS}range"
THING, INVERSE, RESTRICTION, IMPORTS, ONTOLOGY = f"{OWL}Thing", f"{OWL}inverseOf", f"{OWL}Restriction", f"{OWL}imports", f"{OWL}Ontology"
UNINFORMATIVE = (THING, f"{RDFS}Resource", f"{OWL}NamedIndividual")
CHARACTERISTICS = {f"{OWL}TransitiveProperty": "transitive", f"{OWL}SymmetricProperty": "symmetric", f"{OWL}FunctionalProperty": "functional", f"{OWL}InverseFunctionalProperty": "inverse_functional"}
RESTRICTION_PARTS = {f"{OWL}someValuesFrom": "some", f"{OWL}allValuesFrom": "only", f"{OWL}hasValue": "value"}
CARDINALITIES = {f"{OWL}minQualifiedCardinality": "min", f"{OWL}maxQualifiedCardinality": "max", f"{OWL}qualifiedCardinality": "exactly", f"{OWL}minCardinality": "min", f"{OWL}maxCardinality": "max", f"{OWL}cardinality": "exactly"}


def typed(triples: DataFrame, *types: str) -> DataFrame:
    """(uri) of the subjects of a type: classes, properties, individuals."""
    return triples.where((F.col("p") == TYPE) & F.col("o").isin(*types)).select(F.col("s").alias("uri")).distinct()


def classes(triples: DataFrame) -> DataFrame:
    return typed(triples, f"{OWL}Class", f"{RDFS}Class")


def object_properties(triples: DataFrame) -> DataFrame:
    return typed(triples, f"{OWL}ObjectProperty")


def data_properties(triples: DataFrame) -> DataFrame:
    return typed(triples, f"{OWL}DatatypeProperty")


def individuals(triples: DataFrame) -> DataFrame:
    return typed(triples, f"{OWL}NamedIndividual")


def resolved(triples: DataFrame, uris: DataFrame) -> DataFrame:
    """(uri, lane) of the asked uris: class before property before individual before any subject; others have null."""
    order = [("CLS", classes(triples)), ("OPROP", object_properties(triples)), ("DPROP", data_properties(triples)), ("INST", triples.select(F.col("s").alias("uri")).distinct())]
    found = None
    for rank, (lane, df) in enumerate(order):
        one = df.select("uri", F.lit(rank).alias("rank"), F.lit(lane).alias("lane"))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("uri").agg(F.min_by("lane", "rank").alias("lane"))
    return uris.select("uri").distinct().join(best, "uri", "left")


def root_ontology(triples: DataFrame) -> DataFrame:
    """Declared ontologies that no other imports."""
    return typed(triples, ONTOLOGY).join(triples.where(F.col("p") == IMPORTS).select(F.col("o").alias("uri")), "uri", "left_anti")


def named_containing(triples: DataFrame, text: str) -> DataFrame:
    return classes(triples).where(F.lower(R.local_name(F.col("uri"))).contains(text.lower()))


def by_name(triples: DataFrame, names: DataFrame) -> DataFrame:
    """(name, uri): the first class of each name in any case, else the first property."""
    every = classes(triples).withColumn("rank", F.lit(0)).unionByName(object_properties(triples).unionByName(data_properties(triples)).withColumn("rank", F.lit(1)))
    keyed = every.withColumn("key", F.lower(R.local_name(F.col("uri"))))
    return names.withColumn("key", F.lower("name")).join(keyed, "key").groupBy("name").agg(F.min(F.struct("rank", "uri"))["uri"].alias("uri"))


def accepted_language(lang: Column, languages: list[str]) -> Column:
    """Untagged text always; with no list, any."""
    return F.lit(True) if not languages else lang.isNull() | lang.isin(*languages)


def labels(triples: DataFrame, uris: DataFrame | None = None) -> DataFrame:
    """(uri, labels): sorted distinct rdfs:label texts, else the uri's own name."""
    found = triples.where((F.col("p") == LABEL) & (F.trim("o") != "")).groupBy(F.col("s").alias("uri")).agg(F.array_sort(F.collect_set(F.trim("o"))).alias("labels"))
    if uris is None:
        return found
    return uris.select("uri").distinct().join(found, "uri", "left").select("uri", F.coalesce("labels", F.array(R.label_of_uri(F.col("uri")))).alias("labels"))


def annotations(triples: DataFrame, preferred: list[str], synonyms: list[str], others: list[str], languages: list[str] | None = None) -> DataFrame:
    """(uri, preferred, synonym, lexical): sorted texts of the annotation predicates, direct or as the label of their object."""
    every = [*preferred, *synonyms, *others]
    rows = triples.where(F.col("p").isin(*every))
    direct = rows.where("o_is_literal").select("s", "p", "o", "lang")
    far = triples.where((F.col("p") == LABEL) & F.col("o_is_literal")).select(F.col("s").alias("_o"), F.col("o").alias("_label"), F.col("lang").alias("_lang"))
    indirect = rows.where("NOT o_is_literal").join(far, F.col("o") == F.col("_o")).select("s", "p", F.col("_label").alias("o"), F.col("_lang").alias("lang"))
    texts = direct.unionByName(indirect).where(accepted_language(F.col("lang"), languages or []) & (F.trim("o") != ""))
    pick = lambda names: F.array_sort(F.collect_set(F.when(F.col("p").isin(*names), F.trim("o")))) if names else F.array().cast("array<string>")
    return texts.groupBy(F.col("s").alias("uri")).agg(pick(preferred).alias("preferred"), pick(synonyms).alias("synonym"), pick(every).alias("lexical"))


def edges(triples: DataFrame) -> DataFrame:
    """(child, parent) between named classes, without owl:Thing."""
    rows = triples.where((F.col("p") == SUBCLASS) & ~F.col("o_is_literal") & (F.col("o") != THING) & ~F.col("o").startswith("_:") & ~F.col("s").startswith("_:"))
    return rows.select(F.col("s").alias("child"), F.col("o").alias("parent")).where("child <> parent").distinct()


def ancestors(hierarchy: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, ancestor, distance): all ancestors by the shortest way, without the node itself unless it lies on a cycle's way.

    Paths double each round: a round joins the paths found so far with each other, so a chain of n edges takes log2(n)
    rounds. Each round's paths are checkpointed, so the plan doesn't grow.
    """
    work_dir(hierarchy.sparkSession)
    paths = hierarchy.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct().checkpoint()
    n = paths.count()
    for _ in range(rounds):
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node"), F.col("b.ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        paths = paths.unionByName(longer).where("node <> ancestor").groupBy("node", "ancestor").agg(F.min("distance").alias("distance")).checkpoint()
        m = paths.count()
        if m == n:
            return paths
        n = m
    raise RuntimeError(f"the hierarchy is deeper than 2 ** {rounds}")


def descendants(hierarchy: DataFrame) -> DataFrame:
    """(node, descendant, distance)."""
    return ancestors(hierarchy).select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "distance")


def with_self(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    return closure.select("node", "ancestor").unionByName(nodes.select("node", F.col("node").alias("ancestor"))).distinct()


def is_subclass(pairs: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """pairs (sub, sup) with holds."""
    closure = ancestors(hierarchy).select(F.col("node").alias("sub"), F.col("ancestor").alias("sup"), F.lit(True).alias("_in"))
    return pairs.join(closure, ["sub", "sup"], "left").select("sub", "sup", (F.coalesce("_in", F.lit(False)) | (F.col("sub") == F.col("sup"))).alias("holds"))


def levels(hierarchy: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(node, level, member): level 0 is the node; each next level is the ancestors of the last one's members that are not
    ancestors of its other ancestors."""
    closure = ancestors(hierarchy).select(F.col("node").alias("x"), F.col("ancestor").alias("y"))
    current = nodes.select("node", F.col("node").alias("member")).distinct()
    out = current.select("node", F.lit(0).alias("level"), "member")
    for level in range(1, most + 1):
        above = current.join(closure, F.col("member") == F.col("x")).select("node", F.col("y").alias("member")).distinct()
        further = above.join(closure, F.col("member") == F.col("x")).select("node", F.col("y").alias("member")).distinct()
        current = above.join(further, ["node", "member"], "left_anti")
        out = out.unionByName(current.select("node", F.lit(level).alias("level"), "member"))
    return out


def direct_parent(hierarchy: DataFrame) -> DataFrame:
    """(child, parent): the smallest direct parent."""
    return hierarchy.groupBy("child").agg(F.min("parent").alias("parent"))


def siblings(hierarchy: DataFrame, names: DataFrame, most: int, by: str = "name") -> DataFrame:
    """(node, rank, sibling, label): the other children of a node's parents, `most` of each. names: (uri, label).
    by: name (label in lower case, then uri), label or shortest. A parent of very many children makes rows for each
    child's siblings only as far as `most` of them can be kept: ranks are by parent first."""
    label = F.coalesce("label", R.label_of_uri(F.col("child")))
    key = {"name": [F.lower("label")], "label": [F.col("label")], "shortest": [F.length("label"), F.col("label")]}[by]
    children = hierarchy.join(names.select(F.col("uri").alias("child"), "label"), "child", "left").withColumn("label", label)
    # a child sees at most `most` + 1 of a parent's children, itself among them; each counts once, with its first label
    children = children.groupBy("parent", "child").agg(F.min_by("label", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)], "label")).alias("label"))
    order = Window.partitionBy("parent").orderBy(*key, "child")
    best = children.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most + 1)
    mine = hierarchy.select(F.col("child").alias("node"), "parent")
    pairs = mine.join(best, "parent").where("node <> child").select("node", F.col("child").alias("sibling"), "label").distinct()
    key = [F.lower("label")] if by == "name" else [F.col("label")] if by == "label" else [F.length("label"), F.col("label")]
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(*key, "sibling"))).where(F.col("rank") <= most).select("node", "rank", "sibling", "label")


def type_index(triples: DataFrame) -> DataFrame:
    """(type, uri, label): the members of each type with their smallest label."""
    named = labels(triples).select("uri", F.array_min("labels").alias("label"))
    members = triples.where(F.col("p") == TYPE).select(F.col("o").alias("type"), F.col("s").alias("uri")).distinct()
    return members.join(named, "uri", "left").select("type", "uri", F.coalesce("label", R.label_of_uri(F.col("uri"))).alias("label"))


def type_siblings(index: DataFrame, most: int) -> DataFrame:
    """(uri, rank, sibling, label): members of a subject's types, of its informative ones if it has any; types in order of their
    names, members by label and uri, each once at its first place."""
    informative = ~F.col("type").isin(*UNINFORMATIVE)
    own = index.select("uri", "type").withColumn("_any", F.bool_or(informative).over(Window.partitionBy("uri"))).where(informative | ~F.col("_any")).select("uri", "type")
    best = index.withColumn("_rn", F.row_number().over(Window.partitionBy("type").orderBy("label", "uri"))).where(F.col("_rn") <= most + 1).select("type", F.col("uri").alias("sibling"), "label")
    pairs = own.join(best, "type").where("uri <> sibling").groupBy("uri", "sibling").agg(F.min(F.struct("type", "label")).alias("k"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("uri").orderBy("k.type", "k.label", "sibling"))).where(F.col("rank") <= most).select("uri", "rank", "sibling", "k.label")


def predicate_entropy(triples: DataFrame, part: str = "") -> DataFrame:
    """(predicate, entropy): bits of the distribution of a predicate's objects; 0 for one object."""
    counts = triples.where(F.col("p").contains(part)).groupBy("p", "o").agg(F.count("*").alias("c"))
    # sum of c log2 c and of c: the distribution needs no second pass
    sums = counts.groupBy("p").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.log2("c")).alias("cl"), F.count("*").alias("k"))
    return sums.select(F.col("p").alias("predicate"), F.when(F.col("k") <= 1, 0.0).otherwise(F.log2("t") - F.col("cl") / F.col("t")).alias("entropy"))


def merged_entropy(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second).groupBy("predicate").agg(F.max("entropy").alias("entropy"))


def property_view(triples: DataFrame) -> DataFrame:
    """(uri, is_data, domain, range, inverse, characteristics) of the declared properties; names are local ones."""
    kinds = object_properties(triples).withColumn("is_data", F.lit(False)).unionByName(data_properties(triples).withColumn("is_data", F.lit(True)))
    name = R.local_name(F.col("o"))
    parts = triples.where(F.col("p").isin(DOMAIN, RANGE, INVERSE, TYPE) & ~F.col("o").startswith("_:")).groupBy(F.col("s").alias("uri")).agg(
        F.array_sort(F.collect_set(F.when(F.col("p") == DOMAIN, name))).alias("domain"),
        F.array_sort(F.collect_set(F.when(F.col("p") == RANGE, name))).alias("range"),
        F.min(F.when(F.col("p") == INVERSE, name)).alias("inverse"),
        F.array_sort(F.collect_set(F.when(F.col("p") == TYPE, R.lookup(CHARACTERISTICS, F.col("o"))))).alias("characteristics"),
    )
    return kinds.join(parts, "uri", "left")


def property_siblings(view: DataFrame, most: int) -> DataFrame:
    """(uri, rank, sibling): properties of the same kind with a common domain class and, for data properties, a common range or none."""
    # object properties meet by domain, data properties by domain and range (none is a range too): of each group at most `most` + 1 are met
    group = F.when(~F.col("is_data"), F.array(F.lit("any"))).when(F.size("range") == 0, F.array(F.lit(""))).otherwise(F.transform("range", lambda r: F.concat(F.lit("="), r)))
    keyed = view.select("uri", "is_data", F.explode("domain").alias("d"), group.alias("g")).select("uri", "is_data", "d", F.explode("g").alias("g")).distinct()
    first = Window.partitionBy("is_data", "d", "g").orderBy(R.local_name(F.col("uri")), "uri")
    best = keyed.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= most + 1).select(F.col("uri").alias("sibling"), "is_data", "d", "g")
    pairs = keyed.join(best, ["is_data", "d", "g"]).where("uri <> sibling").select("uri", "sibling").distinct()
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("uri").orderBy(R.local_name(F.col("sibling")), "sibling"))).where(F.col("rank") <= most).select("uri", "rank", "sibling")


def relational_signature(triples: DataFrame) -> DataFrame:
    """(uri, as_domain, as_range): sorted labels of the properties that name the class as domain or range."""
    rows = triples.where(F.col("p").isin(DOMAIN, RANGE)).select("s", "p", "o")
    named = rows.join(labels(triples).select(F.col("uri").alias("s"), F.array_min("labels").alias("label")), "s", "left").withColumn("label", F.coalesce("label", R.label_of_uri(F.col("s"))))
    return named.groupBy(F.col("o").alias("uri")).agg(*[F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("label")))).alias(c) for p, c in ((DOMAIN, "as_domain"), (RANGE, "as_range"))])


def restrictions(triples: DataFrame) -> DataFrame:
    """(uri, restriction_type, property_name, filler_name, cardinality) of classes, from their anonymous superclasses."""
    node = triples.where((F.col("p") == TYPE) & (F.col("o") == RESTRICTION)).select(F.col("s").alias("n")).distinct()
    parts = triples.join(node, triples["s"] == node["n"], "left_semi").groupBy(F.col("s").alias("n")).agg(
        F.min(F.when(F.col("p") == f"{OWL}onProperty", R.local_name(F.col("o")))).alias("property_name"),
        F.min(F.when(F.col("p").isin(*RESTRICTION_PARTS, f"{OWL}onClass", f"{OWL}onDataRange"), R.local_name(F.col("o")))).alias("filler_name"),
        F.min(R.lookup(RESTRICTION_PARTS | CARDINALITIES, F.col("p"))).alias("restriction_type"),
        F.min(F.when(F.col("p").isin(*CARDINALITIES), F.col("o").try_cast("int"))).alias("cardinality"),
    )
    owners = triples.where(F.col("p") == SUBCLASS).select(F.col("s").alias("uri"), F.col("o").alias("n"))
    return owners.join(parts, "n").select("uri", "restriction_type", "property_name", "filler_name", "cardinality")


def first_restrictions(rows: DataFrame, most: int) -> DataFrame:
    order = [F.when(F.col("restriction_type") == "some", 0).otherwise(1), "restriction_type", "property_name", "filler_name", "cardinality"]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("uri").orderBy(*order))).where(F.col("rank") <= most)


def instance_context(triples: DataFrame, abstract: list[str], categories: list[str]) -> DataFrame:
    """(uri, types, abstract, categories, data, object) of the subjects: sorted arrays; the abstract is the smallest value of the
    first predicate that has one; data and object hold the other assertions as property structs."""
    handled = [TYPE, LABEL, *abstract, *categories]
    named = labels(triples).select(F.col("uri").alias("_u"), F.array_min("labels").alias("_l"))
    p, o = F.col("p"), F.col("o")
    rank = F.coalesce(*[F.when(p == x, i) for i, x in enumerate(abstract)], F.lit(None).cast("int")) if abstract else F.lit(None).cast("int")
    rows = triples.join(named, ~F.col("o_is_literal") & (F.col("o") == F.col("_u")), "left")
    free = ~p.isin(*handled)
    none = F.lit(None).cast("string")
    one = F.struct(R.local_name(p).alias("predicate_label"), p.alias("predicate_uri"), F.when(F.col("o_is_literal"), o).alias("value"), F.when(F.col("o_is_literal"), R.local_name(F.col("datatype"))).alias("datatype"), F.when(~F.col("o_is_literal"), o).alias("object_uri"), F.when(~F.col("o_is_literal"), F.coalesce("_l", R.label_of_uri(o))).alias("object_label"), none.alias("kind"))
    return rows.groupBy(F.col("s").alias("uri")).agg(
        F.array_sort(F.collect_set(F.when(p == TYPE, R.local_name(o)))).alias("types"),
        F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), o.alias("o"))))["o"].alias("abstract"),
        F.array_sort(F.collect_set(F.when(p.isin(*categories), R.local_name(o)) if categories else none)).alias("categories"),
        F.sort_array(F.collect_set(F.when(free & F.col("o_is_literal"), one))).alias("data"),
        F.sort_array(F.collect_set(F.when(free & ~F.col("o_is_literal"), one))).alias("object"),
    )


def select(triples: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """The bindings of a basic graph pattern: terms that begin with ? are variables, each a column of the result; patterns that share
    variables are joined on them. A null never binds."""
    out = None
    for pattern in patterns:
        names = list(dict.fromkeys(t[1:] for t in pattern if t.startswith("?")))
        rows = triples
        for column, term in zip("spo", pattern, strict=True):
            rows = rows.where(F.col(column).isNotNull() if term.startswith("?") else F.col(column) == term)
        at: dict[str, str] = {}
        for column, term in zip("spo", pattern, strict=True):
            if term.startswith("?"):
                if term[1:] in at:  # a variable twice in one pattern
                    rows = rows.where(F.col(column) == F.col(at[term[1:]]))
                else:
                    at[term[1:]] = column
        rows = rows.select(*[F.col(at[n]).alias(n) for n in names]).distinct()
        if out is None:
            out = rows
        else:
            shared = [n for n in names if n in out.columns]
            if not shared:
                raise ValueError(f"{pattern} shares no variable with the patterns before it")
            out = out.join(rows, shared)
    return out.distinct()


def named(uris: DataFrame, column: str, triples: DataFrame) -> DataFrame:
    """uris with `name`: the smallest label of the column's uri, else its own name."""
    texts = labels(triples).select(F.col("uri").alias("_u"), F.array_min("labels").alias("_l"))
    return uris.join(texts, F.col(column) == F.col("_u"), "left").withColumn("name", F.coalesce("_l", R.label_of_uri(F.col(column)))).drop("_u", "_l")


def ancestor_names(triples: DataFrame) -> DataFrame:
    """(node, names): sorted distinct names of the ancestors."""
    return named(ancestors(edges(triples)).select("node", "ancestor"), "ancestor", triples).groupBy("node").agg(F.array_sort(F.collect_set("name")).alias("names"))


def descendant_names(triples: DataFrame) -> DataFrame:
    """(node, names): sorted distinct names of the descendants."""
    return named(descendants(edges(triples)).select("node", "descendant"), "descendant", triples).groupBy("node").agg(F.array_sort(F.collect_set("name")).alias("names"))


def descendant_names_of(triples: DataFrame, names: DataFrame) -> DataFrame:
    """(name, names): those of the classes of these names, in any case."""
    return by_name(triples, names).join(descendant_names(triples).select(F.col("node").alias("uri"), "names"), "uri").select("name", "names")


def ends_of(triples: DataFrame, predicate: str) -> DataFrame:
    """(uri, ends): the named classes that a property has by rdfs:domain or rdfs:range, sorted."""
    rows = triples.where((F.col("p") == predicate) & ~F.col("o_is_literal") & ~F.col("o").startswith("_:"))
    return rows.groupBy(F.col("s").alias("uri")).agg(F.array_sort(F.collect_set("o")).alias("ends"))


def domain_uris(triples: DataFrame) -> DataFrame:
    return ends_of(triples, DOMAIN)


def range_uris(triples: DataFrame) -> DataFrame:
    return ends_of(triples, RANGE)


def direct_parents(hierarchy: DataFrame) -> DataFrame:
    """(child, parents): all direct ones, sorted."""
    return hierarchy.groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("parents"))


def direct_children(hierarchy: DataFrame) -> DataFrame:
    """(parent, children): all direct ones, sorted."""
    return hierarchy.groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("children"))


def children_by_levels(hierarchy: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(node, level, member): as `levels`, downwards."""
    return levels(hierarchy.select(F.col("parent").alias("child"), F.col("child").alias("parent")), nodes, most)


def used_as_type(triples: DataFrame, uris: DataFrame) -> DataFrame:
    """(uri, used): whether a subject has the uri as its type."""
    types = triples.where((F.col("p") == TYPE) & ~F.col("o_is_literal")).select(F.col("o").alias("uri"), F.lit(True).alias("used")).distinct()
    return uris.select("uri").distinct().join(types, "uri", "left").select("uri", F.coalesce("used", F.lit(False)).alias("used"))


def literals(triples: DataFrame) -> DataFrame:
    """(s, p, text): the lexical forms of literals, without language and datatype."""
    return triples.where("o_is_literal").select("s", "p", F.col("o").alias("text"))


def relatives_names(relations: DataFrame, triples: DataFrame) -> DataFrame:
    """(node, names: array<array<string>>) of relations (node, relative): all names of each relative, in order of the relatives' uris."""
    uris = relations.select(F.col("relative").alias("uri"))
    rows = relations.join(labels(triples, uris).withColumnRenamed("uri", "relative"), "relative")
    return rows.groupBy("node").agg(F.transform(F.array_sort(F.collect_set(F.struct("relative", "labels"))), lambda x: x["labels"]).alias("names"))


def level_synonyms(triples: DataFrame, synonyms: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(node, own, above): the synonyms of the node and, level by level, of the ancestor of the smallest uri there. synonyms (uri,
    synonym); a list that is only the own name of its class is empty."""
    entry = levels(edges(triples), nodes, most).groupBy("node", "level").agg(F.min("member").alias("uri"))
    rows = entry.join(synonyms.select("uri", F.array_sort("synonym").alias("said")), "uri", "left").withColumn("said", F.coalesce("said", F.array().cast("array<string>")))
    clean = F.when((F.size("said") == 1) & (F.get("said", F.lit(0)) == R.local_name(F.col("uri"))), F.array().cast("array<string>")).otherwise(F.col("said"))
    rows = rows.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", clean.alias("said")))), lambda x: x["said"]).alias("every"))
    return rows.select("node", F.get("every", F.lit(0)).alias("own"), F.slice("every", F.lit(2), F.greatest(F.size("every") - 1, F.lit(0))).alias("above"))


def siblings_by_vector(candidates: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """(node, rank, sibling, label, score) of candidates (node, sibling, label): the nearest by cosine, then by label and uri.
    vectors (uri, vector) are unit ones; candidates without a vector aren't ranked."""
    own = vectors.select(F.col("uri").alias("node"), F.col("vector").alias("_a"))
    other = vectors.select(F.col("uri").alias("sibling"), F.col("vector").alias("_b"))
    scored = candidates.join(own, "node").join(other, "sibling").select("node", "sibling", "label", dot(F.col("_a"), F.col("_b")).alias("score"))
    order = Window.partitionBy("node").orderBy(F.desc("score"), "label", "sibling")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("node", "rank", "sibling", "label", "score")
