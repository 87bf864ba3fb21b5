"""Whole pipelines: LaTeX tables to records, symbols to LaTeX, images to results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulaspark.functions.latex import semantics
from formulaspark.operators import calculus, components, features, packed, pixels, polynomials, recognition, structure
from formulaspark.sources.scratch import kept


def process_semantic(formulas: DataFrame, mode: str = "contract") -> DataFrame:
    """``formulas`` with the columns of a semantic record: one projection, no shuffle."""
    return formulas.withColumns(semantics(F.col("latex"), mode))


def solved_records(formulas: DataFrame, mode: str = "contract") -> DataFrame:
    """Semantic records with ``root1, root2`` and ``solution``: equations without errors that are
    polynomials of degree 1 or 2 are solved over the reals; others have null there, and equations a
    warning.  One exchange on ``formula_id`` serves terms, roots and the join."""
    records = process_semantic(formulas, mode)
    roots = polynomials.solve(polynomials.to_terms(formulas)).select("formula_id", "degree", *[(F.round(c, 6) + 0.0).alias(c) for c in ("root1", "root2")])
    open_ = (F.col("formula_type") == "equation") & (F.size("errors") == 0)
    r = records.join(roots, "formula_id", "left")
    r = r.withColumns({c: F.when(open_, F.col(c)) for c in ("root1", "root2")})
    listed = F.array_join(F.transform(F.filter(F.array("root1", "root2"), lambda x: x.isNotNull()), lambda x: x.cast("string")), ", ")
    solution = F.when(F.col("root1").isNotNull(), F.create_map(F.lit("degree"), F.col("degree").cast("string"), F.lit("solutions"), listed))
    unsolved = F.when(open_ & F.col("root1").isNull(), F.array(F.lit("no real solution was found"))).otherwise(F.array().cast("array<string>"))
    told = F.when(F.col("root1").isNotNull(), F.concat("interpretation", F.lit(" Solutions: "), listed, F.lit("."))).otherwise(F.col("interpretation"))
    return r.withColumns({"solution": solution, "warnings": F.concat("warnings", unsolved), "interpretation": told}).drop("degree")


def computed_records(formulas: DataFrame, mode: str = "contract") -> DataFrame:
    """Semantic records with a ``solution`` (fields by name) and what was computed as ``simplified``.

    Equations are solved, expressions expanded and factored, derivatives, integrals and limits of
    polynomials computed; set and logic formulas list their operations and letters.  Formulas with
    errors, and what is no polynomial in one letter, have no solution; equations, derivatives,
    integrals and limits without one get a warning.  One projection: no exchange.
    """
    records = calculus.answered(calculus.computed(process_semantic(formulas, mode)))
    r, kind = F.col("told"), F.col("formula_type")
    asked = F.when(kind == "equation", "solve").when(kind.isin("derivative", "integral", "limit"), kind).when(~kind.isin("set_expression", "logic_expression", "number_set", "unknown"), "simplify")
    fits = (F.size("errors") == 0) & (asked == F.col("computed.method"))
    listed = lambda c: F.array_join(c, ", ")
    special = F.when(
        (kind == "set_expression") & (F.size("operations") > 0),
        F.create_map(F.lit("type"), F.lit("set operations"), F.lit("operations"), listed("operations"), F.lit("elements"), listed("variables")),
    ).when(
        (kind == "logic_expression") & (F.size("operations") > 0),
        F.create_map(F.lit("type"), F.lit("logic expression"), F.lit("quantifiers_or_connectives"), listed("operations"), F.lit("variables"), listed("variables")),
    )
    solved, answer = F.when(fits, r["solution"]), F.when(fits, r["answer"])
    wanted = (F.size("errors") == 0) & kind.isin("equation", "derivative", "integral", "limit")
    warnings = F.concat("warnings", F.when(wanted & answer.isNull(), F.array(F.lit("no solution was found"))).otherwise(F.array().cast("array<string>")))
    told = F.concat("interpretation", F.when(answer.isNotNull() & (asked != "simplify"), F.concat(F.lit(" Result: "), answer, F.lit("."))).otherwise(""))
    out = {"simplified": F.coalesce("simplified", F.when(fits & answer.isNotNull(), r["simplified"])), "solution": F.coalesce(solved, special), "warnings": warnings, "interpretation": told}
    return records.withColumns(out).drop("computed", "told")


def symbol_pictures(images: DataFrame, side: int = 32) -> DataFrame:
    """Pixel tables of single symbols, brought to ``side`` by ``side`` with a white background."""
    return packed.pictures(images, lambda key, y, x, v: features.on_white(*pixels.padded(*pixels.resized(y, x, v, side, side), side, side)))


def train_recognizer(images: DataFrame, kind: str = "svm", side: int = 32) -> tuple[recognition.Recognizer, DataFrame, DataFrame]:
    """From labelled images (``image_id, label, width, data``): a recognizer, the report of its held-out
    rows with averages, and their accuracy."""
    vectors = features.feature_vectors(kept(symbol_pictures(pixels.to_pixels(images), side), "pictures"), side)
    labelled = kept(vectors.join(images.select("image_id", "label"), "image_id").withColumnRenamed("image_id", "id"), "training-vectors")
    made, pairs = recognition.train(labelled, kind)
    pairs = kept(pairs, "held-out")
    report = recognition.classification_report(pairs)
    return made, report.unionByName(recognition.report_averages(report)), recognition.accuracy(pairs)


def recognize(images: DataFrame, model: recognition.Recognizer | None = None, side: int = 32, large_operators: bool = False) -> DataFrame:
    """What every image says: ``image_id, success, latex, num_symbols, symbols, syntax_tree``, the semantic
    record (``formula_type, variables, operations, simplified, solution, interpretation``), ``errors, warnings``.

    ``symbols`` are structs in reading order with box, label, confidence and up to three candidates;
    doubtful labels that are easily confused are settled by their neighbours.  With
    ``large_operators`` symbols that are read as sums or integrals take limits.

    ``images`` has ``image_id`` of any type, ``height, width`` and ``data``, a byte a pixel; each has
    its own size.  An image whose data do not fit its size, or that has none, is a row with an
    error; one without ink a row with a warning.  Images of at most 64 by 64 are one symbol.
    """
    fits = F.coalesce((F.col("height") > 0) & (F.col("width") > 0) & (F.length("data") == F.col("height") * F.col("width")), F.lit(False))
    known = kept(images.select("image_id", "height", "width", "data", fits.alias("fits")), "images")
    # pixels stay packed: no row a pixel is written, joined or counted
    binary = kept(pixels.preprocess(pixels.to_chunks(known.where("fits")), kind=packed.CHUNK), "binary")
    inked = packed.each(binary, lambda key, y, x, v: ([1],) if (v > 0).any() else None, "ink int", dealt=False).select("image_id").distinct()
    alone = components.single_symbols(binary).join(inked, "image_id", "left_semi").select("image_id", F.lit(0).alias("sym_idx"), "x", "y", "w", "h", F.lit(False).alias("is_fraction_line"), F.lit(False).alias("is_sqrt"))
    several = components.segment(kept(binary.join(alone.select("image_id"), "image_id", "left_anti"), "several"))
    found = kept(several.unionByName(alone), "symbols")
    symbols = found.withColumnRenamed("image_id", "formula_id").withColumns({"is_sum": F.lit(False), "is_integral": F.lit(False)})
    guessed = None
    if model is not None:
        key = F.struct("image_id", "sym_idx")
        crops = components.crop_symbols(found.withColumnRenamed("sym_idx", "comp_id"), binary).withColumnRenamed("comp_id", "sym_idx")
        pictures = symbol_pictures(crops.select(F.to_json(key).alias("image_id"), "y", "x", (255 - F.col("v")).alias("v")), side)
        vectors = features.feature_vectors(kept(pictures, "pictures"), side).withColumnRenamed("image_id", "id")
        names = found.select(F.to_json(key).alias("id"), F.col("image_id").alias("formula_id"), "sym_idx")
        guessed = kept(model.predict(vectors).join(names, "id").select("formula_id", "sym_idx", "pred", "prob", "candidates"), "guessed")
    labels = recognition.recognize_symbols(symbols, guessed)
    order = structure.reading_order(symbols.join(labels, ["formula_id", "sym_idx"]))
    if guessed is not None:
        second = guessed.select("formula_id", "sym_idx", F.get("candidates", 1)["label"].alias("second"))
        settled = recognition.resolve_ambiguity(symbols.join(labels, ["formula_id", "sym_idx"]), order, second)
        labels = settled.join(labels.drop("label"), ["formula_id", "sym_idx"]).join(guessed.select("formula_id", "sym_idx", "candidates"), ["formula_id", "sym_idx"], "left")
    else:
        labels = labels.withColumn("candidates", F.lit(None).cast("array<struct<label:string,prob:double>>"))
    labelled = kept(symbols.join(labels, ["formula_id", "sym_idx"]).join(order.select("formula_id", "sym_idx", "rank"), ["formula_id", "sym_idx"]), "labelled")
    if large_operators:
        labelled = structure.flag_large_operators(labelled)
    read = structure.read_trees(kept(structure.syntax_trees(labelled.drop("candidates", "rank")), "trees"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "sym_idx", "x", "y", "w", "h", "label", "confidence", "candidates")))
    counted = labelled.groupBy("formula_id").agg(F.count("*").cast("int").alias("num_symbols"), listed.alias("symbols"))
    out = known.select(F.col("image_id").alias("formula_id"), "fits").join(read, "formula_id", "left").join(counted, "formula_id", "left")
    out = computed_records(out)
    n = F.coalesce("num_symbols", F.lit(0))
    broken = F.array(F.lit("the image cannot be read"))
    errors = F.when(~F.col("fits"), broken).when(n == 0, F.array().cast("array<string>")).otherwise(F.col("errors"))
    warnings = F.when(F.col("fits") & (n == 0), F.array(F.lit("no symbols"))).when(n == 0, F.array().cast("array<string>"))
    warnings = warnings.when(F.lit(model is None), F.concat("warnings", F.array(F.lit("no model")))).otherwise(F.col("warnings"))
    found = [F.when(n > 0, F.col(c)).alias(c) for c in ("formula_type", "variables", "operations", "simplified", "solution", "interpretation")]
    return out.select(F.col("formula_id").alias("image_id"), (n > 0).alias("success"), "latex", n.alias("num_symbols"), "symbols", F.col("tree").alias("syntax_tree"), *found, errors.alias("errors"), warnings.alias("warnings"))
