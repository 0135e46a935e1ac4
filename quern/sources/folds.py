"""Structure files: fold discovery in directories and nested archives, and mmCIF atoms and residues."""

from __future__ import annotations

import io
import json
import re
import shlex
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of members that travel at once.
_HANDED = 32 << 20


def _ignored(name: str) -> bool:
    return any(p == "__MACOSX" or p.startswith("._") for p in name.split("/"))


def _members(locator: str, data: bytes):
    """(locator, bytes) of the files in an archive, nested archives included; ``!/`` marks a border."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            if info.is_dir() or _ignored(info.filename):
                continue
            inner = f"{locator}!/{info.filename}"
            body = z.read(info)
            if info.filename.lower().endswith(".zip"):
                yield from _members(inner, body)
            else:
                yield inner, body


def files(spark: SparkSession, path: str) -> DataFrame:
    """locator, content of every file below path, through archives of any depth; an unreadable archive is a problem row.

    Members are handed on as they are read, _HANDED bytes at a time.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def found(p, c):
        if p.lower().endswith(".zip"):
            try:
                for locator, body in _members(p, bytes(c)):
                    yield locator, body, None
            except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:  # broken, or packed or locked in a way that can't be read
                yield p, None, str(e)
        else:
            yield p, c, None

    def expand(batches):
        for pdf in batches:
            out, held = [], 0
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                for row in () if _ignored(p) else found(p, c):
                    out.append(row)
                    held += len(row[1] or b"")
                    if held > _HANDED:
                        yield pd.DataFrame(out, columns=["locator", "content", "problem"])
                        out, held = [], 0
            yield pd.DataFrame(out, columns=["locator", "content", "problem"])

    return raw.mapInPandas(expand, "locator string, content binary, problem string")


def folds(found: DataFrame) -> DataFrame:
    """fold (directory locator), models (sorted numbers), summaries; a directory without models is a candidate with none."""
    d = found.select(F.regexp_replace("locator", r"/[^/]*$", "").alias("fold"), "locator")
    number = F.regexp_extract("locator", r"_model_([0-9]+)\.cif$", 1).try_cast("int")
    return d.groupBy("fold").agg(F.array_sort(F.collect_set(number)).alias("models"), F.array_sort(F.collect_set(F.when(F.col("locator").contains("summary_confidences"), F.col("locator")))).alias("summaries"))


def _seed(request) -> tuple:
    """The seed of a job request's text, or what is wrong with it."""
    try:
        d = json.loads(bytes(request))
    except ValueError:
        return None, "request"
    if isinstance(d, list):
        d = d[0] if len(d) == 1 else None
    if not isinstance(d, dict):
        return None, "request"
    seeds = d.get("modelSeeds")
    if not isinstance(seeds, list) or len(seeds) != 1:
        return None, "seeds"
    seed = seeds[0]
    if isinstance(seed, str) and re.fullmatch("[0-9]+", seed):
        seed = int(seed)
    return (seed, None) if isinstance(seed, int) and not isinstance(seed, bool) and 0 <= seed < 1 << 63 else (None, "seed")


#: What a model and the files beside it are called, before _<n>, and how they end.
_BESIDE = {"model": ".cif", "full_data": ".json", "summary_confidences": ".json"}


def model_inputs(found: DataFrame, selected: int | None = None) -> DataFrame:
    """source (the fold's locator), model, cif, data, summary, request (locators), seed, problem of every model among found (locator, content).

    A model is <name>model_<n>.cif beside <name>full_data_<n>.json, and, where they are there, <name>summary_confidences_<n>.json and
    <name>job_request.json; in archives a locator goes on behind ``!/``.  ``model0_complex.cif`` is an assembly, model 0, without data.  Problems,
    each a row: models (a number that several files of a fold have), data (none, or several), summary (several), request, seeds, seed (of the
    request), and, where one model is selected, selected for a fold that lacks it (with that number and no files).
    """
    # Names are taken apart by plain string functions: a directory has many more files than models.
    name = F.substring_index("locator", "/", -1)
    directory = F.when(F.contains("locator", F.lit("/")), F.expr("left(locator, length(locator) - length(substring_index(locator, '/', -1)) - 1)")).otherwise(F.col("locator"))
    whole = F.col("name") == "model0_complex.cif"
    ended = F.endswith("name", F.lit(".cif")) | F.endswith("name", F.lit(".json"))
    named = found.select("locator", directory.alias("source"), name.alias("name")).where(ended).withColumn("base", F.expr("left(name, length(name) - if(endswith(name, '.cif'), 4, 5))"))
    named = named.withColumn("number", F.substring_index("base", "_", -1)).withColumn("head", F.expr("left(base, length(base) - length(number) - 1)"))
    kind = F.when(whole, "model")
    for k, tail in _BESIDE.items():
        kind = kind.when(F.endswith("head", F.lit(f"_{k}")) & F.endswith("name", F.lit(tail)) & (F.col("number") != "") & (F.translate("number", "0123456789", "") == ""), k)
    named = named.select("source", "locator", "head", "number", kind.alias("kind"), whole.alias("assembly"))
    stem, number = F.expr("left(head, length(head) - length(kind))"), F.col("number").try_cast("int")
    parts = named.select("source", "locator", F.when(F.col("assembly"), "").otherwise(stem).alias("stem"), F.when(F.col("assembly"), 0).otherwise(number).alias("model"), "kind", "assembly").where("kind IS NOT NULL AND model IS NOT NULL")
    if selected is not None:
        every = parts.where("kind = 'model'").select("source").distinct()
        parts = parts.where(F.col("model") == selected)

    requests = found.where(F.endswith("locator", F.lit("_job_request.json")) & F.col("content").isNotNull())

    def read_seeds(batches):
        for batch in batches:
            seeds = [_seed(c) for c in batch["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["locator"], pa.array([s for s, _ in seeds], pa.int64()), pa.array([w for _, w in seeds], pa.string())], ["locator", "seed", "wrong"])

    seeds = requests.select("locator", "content").mapInArrow(read_seeds, "locator string, seed long, wrong string")
    asked = seeds.select(directory.alias("source"), "locator", F.expr("left(substring_index(locator, '/', -1), length(substring_index(locator, '/', -1)) - length('job_request.json'))").alias("stem"), F.lit("request").alias("kind"), "seed", "wrong")
    # All files of a fold come together once; what lies beside a model is found along one order.
    fold = parts.unionByName(asked, allowMissingColumns=True).repartition("source")
    by_stem, by_model, same = (Window.partitionBy(*k) for k in (("source", "stem"), ("source", "stem", "model"), ("source", "model")))
    one = lambda k, c="locator": F.min(F.when(F.col("kind") == k, F.col(c)))
    n = lambda k: F.count_if(F.col("kind") == k)
    j = fold.select(
        "source", "stem", "model", "kind", "locator", "assembly", *(f(k).over(by_model).alias(label) for k, short in (("full_data", "data"), ("summary_confidences", "summary")) for f, label in ((one, short), (n, f"n_{short}"))),
        one("request").over(by_stem).alias("request"), n("request").over(by_stem).alias("n_request"), one("request", "seed").over(by_stem).alias("seed"), one("request", "wrong").over(by_stem).alias("wrong"),
    )
    models = j.where("kind = 'model'")
    j = models.withColumn("n_models", F.count(F.lit(1)).over(same))
    problem = (
        F.when(F.col("n_models") > 1, "models").when(F.col("assembly"), None).when(F.coalesce("n_data", F.lit(0)) != 1, "data").when(F.col("n_summary") > 1, "summary")
        .when(F.col("n_request") > 1, "request").otherwise(F.col("wrong"))
    )
    out = j.select("source", "model", F.col("locator").alias("cif"), "data", "summary", "request", "seed", problem.alias("problem"))
    if selected is not None:
        lacking = every.join(models.select("source"), "source", "left_anti")
        out = out.unionByName(lacking.select("source", F.lit(selected).alias("model"), *(F.lit(None).cast("string").alias(c) for c in ("cif", "data", "summary", "request")), F.lit(None).cast("long").alias("seed"), F.lit("selected").alias("problem")))
    return out


def _atom_rows(text: str):
    """Rows of the _atom_site loop as dictionaries; None for a row with other than a cell for each column."""
    lines = iter(text.splitlines())
    for line in lines:
        if line.strip() == "loop_":
            names, row = [], next(lines, "")
            while row.startswith("_"):
                names.append(row.strip())
                row = next(lines, "")
            if not names or not names[0].startswith("_atom_site."):
                continue
            keys = [n.split(".", 1)[1] for n in names]
            while row and not row.startswith(("#", "loop_", "_", "data_")):
                try:
                    cells = shlex.split(row) if "'" in row or '"' in row else row.split()
                except ValueError:  # an open quotation mark
                    cells = []
                yield dict(zip(keys, cells, strict=True)) if len(cells) == len(keys) else None
                row = next(lines, "")


def _number(text: str | None) -> float:
    try:
        return float(text or "nan")
    except ValueError:
        return float("nan")


ATOMS = "model string, chain string, number int, resname string, name string, element string, x double, y double, z double, plddt double, problem string"


def atoms(found: DataFrame) -> DataFrame:
    """Atoms of the polymers in mmCIF files; alternative locations, several models in a file, numbers that aren't whole and
    coordinates that aren't finite are problems, and so are rows with cells missing or too many (``columns``, nothing else known).  Rows
    without a place in the sequence (``.``: ligands, water) are left out."""

    def parse(batches):
        for pdf in batches:
            out = []
            for locator, content in zip(pdf["locator"], pdf["content"], strict=True):
                seen = set()
                for a in _atom_rows(bytes(content).decode("utf-8", "replace")):
                    if a is None or not {"label_asym_id", "label_comp_id", "label_atom_id"} <= a.keys():
                        out.append((locator, None, None, None, None, None, *(float("nan"),) * 4, "columns"))
                        continue
                    seen.add(a.get("pdbx_PDB_model_num", "1"))
                    place = a.get("label_seq_id", ".")
                    if place in (".", "?"):
                        continue
                    xyz = [_number(a.get(f"Cartn_{c}")) for c in "xyz"]
                    seq = int(place) if re.fullmatch(r"-?[0-9]+", place) else None
                    bad = "number" if seq is None else "models" if len(seen) > 1 else "altloc" if a.get("label_alt_id", ".") not in (".", "?") else None if all(abs(v) < 1e9 for v in xyz) else "coordinates"
                    out.append((locator, a["label_asym_id"], seq, a["label_comp_id"], a["label_atom_id"], a.get("type_symbol", ""), *xyz, _number(a.get("B_iso_or_equiv")), bad))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ATOMS.split(", ")])

    return found.where(F.col("locator").endswith(".cif") & F.col("content").isNotNull()).mapInPandas(parse, ATOMS)


def _model_of(locator: str) -> str:
    """The locator of the model that a full-data file is about."""
    return re.sub(r"_full_data_(\d+)\.json$", r"_model_\1.cif", locator)


def _json(content) -> dict:
    """The object of a JSON text; an empty one where the text holds none."""
    try:
        d = json.loads(bytes(content))
    except ValueError:  # also what isn't UTF-8
        return {}
    return d if isinstance(d, dict) else {}


TOKENS = "model string, token_index int, chain string, number int, problem string"


def tokens(found: DataFrame) -> DataFrame:
    """Tokens of full-data JSON texts in their order, with the chain and residue each stands for; lists that are missing (or in
    no readable JSON), of different lengths, with ids that are no whole numbers, or unlike the error matrix make one problem row of their model."""

    def parse(batches):
        for pdf in batches:
            out = []
            for locator, content in zip(pdf["locator"], pdf["content"], strict=True):
                model, d = _model_of(locator), _json(content)
                chains, numbers, matrix = (d.get(k) for k in ("token_chain_ids", "token_res_ids", "pae"))
                if not isinstance(chains, list) or not isinstance(numbers, list) or len(chains) != len(numbers):
                    out.append((model, None, None, None, "token lists"))
                elif any(isinstance(n, bool) or not isinstance(n, int) or abs(n) >= 1 << 31 for n in numbers) or any(c is None for c in chains):
                    out.append((model, None, None, None, "token ids"))
                elif not isinstance(matrix, list) or any(not isinstance(r, list) or len(r) != len(chains) for r in matrix) or len(matrix) != len(chains):
                    out.append((model, None, None, None, "matrix"))
                else:
                    out += [(model, i, str(c), int(n), None) for i, (c, n) in enumerate(zip(chains, numbers, strict=True))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TOKENS.split(", ")]).astype({"token_index": "Int32", "number": "Int32"})

    return found.where(F.col("locator").contains("full_data") & F.col("content").isNotNull()).mapInPandas(parse, TOKENS)


# Residues that are one token each.
STANDARD = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()


def residues(atom_table: DataFrame, token_table: DataFrame) -> DataFrame:
    """model, chain, number, resname, plddt, x, y, z of each residue's Cα, its tokens, the first of them, and a problem.

    Residues and tokens meet by chain and number: a residue without a token, a token without a Cα, a second token of a
    standard residue, and a modified one with other than a token per heavy atom are problems.
    """
    key = ["model", "chain", "number"]
    heavy = F.count_if(~F.upper("element").isin("H", "D")).alias("heavy")
    ca = atom_table.where("name = 'CA'").groupBy(*key).agg(F.first("resname").alias("resname"), *(F.first(c).alias(c) for c in ("plddt", "x", "y", "z")), F.max("problem").alias("bad"))
    ca = ca.join(atom_table.groupBy(*key).agg(heavy), key)
    told = token_table.where("problem IS NULL").groupBy(*key).agg(F.array_sort(F.collect_list("token_index")).alias("tokens"))
    n = F.size("tokens")
    problem = (
        F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("tokens").isNull(), "no token").when(F.col("heavy").isNull(), "no atom").when((n > 1) & F.col("resname").isin(*STANDARD), "tokens")
        .when((n > 1) & (n != F.col("heavy")), "modified residue")
    )
    whole = token_table.where("problem IS NOT NULL").select("model", *(F.lit(None).cast(t).alias(c) for c, t in (("chain", "string"), ("number", "int"), ("resname", "string"), ("plddt", "double"), ("x", "double"), ("y", "double"), ("z", "double"), ("tokens", "array<int>"), ("token_index", "int"))), "problem")
    j = ca.join(told, key, "full_outer")
    return j.select(*key, "resname", "plddt", "x", "y", "z", "tokens", F.get("tokens", F.lit(0)).alias("token_index"), problem.alias("problem")).unionByName(whole)


def pae(found: DataFrame) -> DataFrame:
    """model locator, i, j, value of full-data JSON texts; none of those that aren't readable, and null for what is no number (``tokens`` has the problem)."""

    def parse(batches):
        for pdf in batches:
            out = []
            for locator, content in zip(pdf["locator"], pdf["content"], strict=True):
                m = _json(content).get("pae")
                plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
                out += [(_model_of(locator), i, j, plain(v)) for i, row in enumerate(m if isinstance(m, list) else []) for j, v in enumerate(row if isinstance(row, list) else [])]
            yield pd.DataFrame(out, columns=["model", "i", "j", "value"]).astype({"value": "float64"})

    return found.where(F.col("locator").contains("full_data")).mapInPandas(parse, "model string, i int, j int, value double")
