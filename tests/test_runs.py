import json

import pytest

from weftline.plans import config, evaluate, run


def test_whole_run(spark, tmp_path):
    (tmp_path / "init.txt").write_text("".join(f"s{i}|t{i}|=|0.5|CLS\n" for i in range(8)))
    (tmp_path / "ask.txt").write_text("".join(f"s{i}|t{i}|=|0.5|CLS\n" for i in range(4)) + "s9|t9|=|0.5|INST\n")
    (tmp_path / "ref.tsv").write_text("SrcEntity\tTgtEntity\tScore\n" + "".join(f"s{i}\tt{i}\t1.0\n" for i in range(6)))
    (tmp_path / "c.toml").write_text(f'[task]\ninitial_alignment = "{tmp_path}/init.txt"\nasked = "{tmp_path}/ask.txt"\nreference = "{tmp_path}/ref.tsv"\n[prompts]\ntemplate = "sub_labels_only"\n[oracle]\nmodulus = 1\n[output]\nfolder = "{tmp_path}/out"\nmetrics = ["global", "stratified"]\n')
    kind = "uri string, e struct<names:array<string>,synonyms:array<string>,own_name:string,parent:string>"
    side = lambda x: {"CLS": spark.createDataFrame([(f"{x}{i}", ([f"{x} {i}"], [], "n", None)) for i in range(4)], kind)}
    got = run.run(spark, config.load(str(tmp_path / "c.toml")), side("s"), side("t"))
    assert got["verdicts"] == {"true": 4, "skipped": 1} and got["status"] == "degraded" and got["skipped"] == 1
    assert (got["evaluation"]["global"]["tp"], got["evaluation"]["global"]["fp"], got["evaluation"]["global"]["fn"]) == (6, 2, 0)
    assert json.loads((tmp_path / "out" / "run_result.json").read_text())["run_id"] == got["run_id"]


def test_config_is_strict(tmp_path):
    with pytest.raises(ValueError, match="unknown keys"):
        config.build({"task": {"nam": "x"}})
    with pytest.raises(ValueError, match="unknown template"):
        config.build({"prompts": {"template": "x"}})
    assert config.build({}).run_id == config.build({"output": {"folder": "elsewhere"}}).run_id
    assert ("a.b", 1) in config.flat({"a": {"b": 1}})
    with pytest.raises(ValueError, match="not set"):
        config.secret("ENV:SURELY_UNSET")
    assert evaluate.options_of(["edition.edition=2026", "plain.x=true"]) == {"edition": {"edition": 2026}, "plain": {"x": True}}
    with pytest.raises(ValueError, match="unknown engine"):
        evaluate.engine("x")


def test_examples_need_a_source():
    with pytest.raises(ValueError, match="operators.retrieval"):
        config.build({"few_shot": {"strategy": "rag", "k": 2}})
    with pytest.raises(ValueError, match="train_reference"):
        config.build({"few_shot": {"strategy": "random", "k": 2}})


HEAD = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xml:base="http://%s/o">'


def ontology(name):
    parts = [HEAD % name, '<owl:Ontology rdf:about=""/>', '<owl:Class rdf:ID="top"><rdfs:label>Top thing</rdfs:label></owl:Class>']
    for i in range(6):
        parts.append(f'<owl:Class rdf:about="#c{i}"><rdfs:label xml:lang="en">{name} class {i}</rdfs:label><rdfs:subClassOf rdf:resource="#top"/><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#has"/><owl:someValuesFrom rdf:resource="#top"/></owl:Restriction></rdfs:subClassOf></owl:Class>')
    parts.append('<owl:ObjectProperty rdf:about="#has"><rdfs:label>has</rdfs:label><rdfs:domain rdf:resource="#c0"/><rdfs:range rdf:resource="#top"/></owl:ObjectProperty>')
    parts.append('<rdf:Description rdf:about="#item"><rdf:type rdf:resource="#c1"/><rdfs:label>Item</rdfs:label></rdf:Description></rdf:RDF>')
    return "".join(parts)


def test_from_ontologies_to_questions(spark, tmp_path):
    for x in "ab":
        (tmp_path / f"{x}.owl").write_text(ontology(x))
    pairs = [(f"http://a/o#c{i}", f"http://b/o#c{i}") for i in range(6)]
    (tmp_path / "init.txt").write_text("".join(f"{s}|{t}|=|0.5|CLS\n" for s, t in pairs))
    (tmp_path / "ask.txt").write_text("".join(f"{s}|{t}|=|0.5|CLS\n" for s, t in pairs[:2]) + "http://a/o#has|http://b/o#has|=|0.5|OPROP\nhttp://a/o#item|http://b/o#item|=|0.5|INST\n")
    (tmp_path / "train.tsv").write_text("".join(f"{s}\t{t}\t1.0\n" for s, t in pairs[2:]))
    setting = config.build({"task": {"initial_alignment": f"{tmp_path}/init.txt", "asked": f"{tmp_path}/ask.txt", "train_reference": f"{tmp_path}/train.tsv", "source_ontology": f"{tmp_path}/a.owl", "target_ontology": f"{tmp_path}/b.owl"}, "prompts": {"template": "one_level_of_parents"}, "few_shot": {"strategy": "hard", "k": 4}, "output": {"folder": f"{tmp_path}/out"}})
    log = tmp_path / "calls"
    log.mkdir()

    def ask(turns):
        import uuid

        (log / uuid.uuid4().hex).write_text(json.dumps(turns))
        return '{"answer": true}'

    got = run.run(spark, setting, ask=ask)
    calls = [json.loads(f.read_text()) for f in log.iterdir()]
    assert got["verdicts"] == {"true": 4} and got["status"] == "success" and got["skipped"] == 0
    assert len(calls) == 4  # one call for each question
    for turns in calls:
        assert [r for r, _ in turns] == ["developer"] + ["user", "assistant"] * 4 + ["user"]
        assert [c for r, c in turns if r == "assistant"] == ['{"answer": true}', '{"answer": false}'] * 2
    asked = [turns[-1][1] for turns in calls]
    assert sum("a class 0" in q and "b class 0" in q and "Top thing" in q for q in asked) == 1 and sum('"has"' in q for q in asked) == 1
    restrictions = run.from_ontologies(spark, setting)[0]["CLS"].where("uri = 'http://a/o#c3'").select("e.*").head()
    assert [r["property_name"] for r in restrictions["restrictions"]] == ["has"] and restrictions["siblings"] == ["a class 0", "a class 1"] and restrictions["levels"][:2] == ["a class 3", "Top thing"]
