"""Commands on span tables: ``python -m spanlake COMMAND ...``. A command is a function that registers its arguments."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import conditioned, demography, hmm, ingest, joint, measures, models, sampling, spans, split, splines
from .sources import chunks, formats, indexed, text

COMMANDS: dict[str, tuple[Callable, list[tuple[tuple, dict]]]] = {}


def option(*names: str, **how: object) -> tuple[tuple, dict]:
    return names, how


def command(*options: tuple[tuple, dict]) -> Callable:
    """Register a function of (spark, arguments) as the command of its name."""

    def register(f: Callable) -> Callable:
        COMMANDS[f.__name__.rstrip("_")] = f, list(options)
        return f

    return register


MU, RHO = option("--mu", type=float, required=True, help="mutations a base and generation"), option("--r", type=float, help="recombinations; default: as mu")
DATA, OUT = option("spans", help="Parquet of contig_id, seq, span, a1, b1, nb1 (and a2, b2, nb2); or a span file, or @ and a file that lists them"), option("out")


def _rows(spark: SparkSession, path: str):
    """The span rows that a command is given. Files are checked by their headers: at most two populations, a pair of
    distinguished lineages in each file's first; those with the pair in the second have their populations exchanged."""
    if not path.startswith("@") and text.exists(spark, f"{path}/_SUCCESS"):
        rows = spark.read.parquet(path)
        if missing := {"contig_id", "seq", "span", "a1", "b1", "nb1"} - set(rows.columns):
            raise SystemExit(f"{path} misses the columns {', '.join(sorted(missing))}")
        if spans.bad_rows(rows, (2,) * len(spans.populations(rows))).limit(1).count():
            raise SystemExit(f"{path} has rows with no bases, more than two derived alleles of a pair, or more than were sampled")
        return rows
    paths = text.expand(spark, [path])
    if empty := [r.file for r in text.empty_files(spark, paths).collect()]:
        raise SystemExit(f"no rows in {', '.join(empty)}")
    heads = text.headers(spark, paths).withColumnRenamed("file", "contig_id").persist()
    many = {len(r.pids) for r in heads.select("pids").distinct().collect()}
    if len(many) != 1 or max(many) > 2:
        raise SystemExit("files of one kind are needed: all of one population, or all of two")
    rows = text.read_spans(spark, paths, many.pop())
    bad = [r.contig_id for r in spans.load_checks(rows, heads).where("not ok").collect()]  # files, not rows
    if bad:
        raise SystemExit(f"headers and rows do not agree in {', '.join(bad)}")
    if "a2" in rows.columns:
        rows = spans.canonical(rows.join(heads.select("contig_id", F.size(F.col("dist")[1]).alias("dist2")), "contig_id")).drop("dist2")
    return rows


@command(option("vcf"), OUT, option("population", nargs="+", help="name:sample,sample or name:@file; one or two"), option("--distinguished", nargs=2, help="samples of the two distinguished haplotypes"), option("--mask", help="BED"), option("--missing-cutoff", type=int), option("--contig", help="only this one; of an indexed file, only its part is read"), option("--length", type=int, help="of every contig"), option("--ignore-missing", action="store_true"), option("--drop-first-last", action="store_true"))
def convert(spark: SparkSession, args: argparse.Namespace) -> None:
    """Variant calls and a mask to span rows; the first record of a position counts."""
    if args.mask and args.missing_cutoff is not None:
        raise SystemExit("--mask says what is missing; --missing-cutoff guesses it: give one of them")
    names = text.vcf_samples(spark, args.vcf)
    populations = dict(text.sample_list(p, spark) for p in args.population)
    asked = [s for samples in populations.values() for s in samples]
    if not 1 <= len(populations) <= 2:
        raise SystemExit("one or two populations are needed")
    if (lost := sorted(set(asked) - set(names))) and not args.ignore_missing:
        raise SystemExit(f"no samples {', '.join(lost)}; they can be left out with --ignore-missing")
    pair = args.distinguished or [asked[0]] * 2
    if set(pair) - set(names):
        raise SystemExit("the distinguished samples are not there")
    populations = {p: [s for s in samples if s in names] for p, samples in populations.items()}
    roles = ingest.lineages(spark, populations, [(pair[0], 0), (pair[1], 1)])
    variants = ingest.first_per_position(ingest.snps(text.read_variants(spark, args.vcf, args.contig)).withColumn("_at", F.monotonically_increasing_id()), ["_at"])
    calls = text.genotypes(variants, names, diploid=pair)
    na = tuple(sum(s in populations[p] for s in pair) for p in populations)
    sites = ingest.fold_monomorphic(ingest.project_roles(calls, roles, len(populations)), na)
    lengths = text.declared_lengths(spark, args.vcf)
    lengths = lengths.withColumn("length", F.lit(args.length).cast("bigint") if args.length else F.coalesce("length", F.raise_error(F.lit("no contig length; see --length")).cast("bigint")))
    lengths = lengths.select("*", *[F.lit(2 * len(samples) - n).alias(f"n{i}") for i, (samples, n) in enumerate(zip(populations.values(), na, strict=True), 1)])
    mask = text.read_bed(spark, args.mask) if args.mask else None
    if args.contig:
        lengths = lengths.where(F.col("contig") == args.contig)
        mask = mask.where(F.col("contig") == args.contig) if mask else None
    found = ingest.gap_fill(ingest.events(sites, mask), lengths, args.missing_cutoff, args.drop_first_last)
    spans.compress(found).write.parquet(args.out)


@command(option("vcf"), option("--range", type=int, default=indexed.RANGE, help="bytes that are read together"))
def index(spark: SparkSession, args: argparse.Namespace) -> None:
    """Where each contig lies in a file of variant calls, kept beside it: later scans of one contig read its part only."""
    indexed.index(spark, args.vcf, size=args.range)


@command(DATA, OUT, option("--size", type=int, default=5_000_000), option("--draws", type=int), option("--seed", type=int, default=0), option("--text", help="a file of span rows: write text files, with its header, in place of Parquet"))
def chunk(spark: SparkSession, args: argparse.Namespace) -> None:
    """Chunks of equal size, drawn with replacement where asked; as Parquet, or a text file each."""
    cut = spans.chunk(_rows(spark, args.spans), args.size)
    rows = chunks.numbered(cut, ["contig_id", "win"])
    if args.draws:
        drawn = sampling.bootstrap(rows.select("chunk").distinct(), args.draws, args.seed, "chunk")
        rows = rows.join(drawn, "chunk").drop("chunk").withColumnRenamed("draw", "chunk")
    if args.text:
        header = spark.read.text(args.text).where(F.col("value").startswith("#")).first()
        chunks.write_chunks(rows, args.out, header.value if header else "")
    else:
        rows.write.partitionBy("chunk").parquet(args.out)


def _prepared(data, args: argparse.Namespace, n: int):
    """The chain before a fit: thinned, binned, recoded, compressed; contigs that tell nothing go."""
    rows = spans.thin(data, args.thinning or spans.default_thinning(n)).withColumn("seq", F.col("start")).drop("start")
    binned = spans.recode_monomorphic(spans.bin_observations(rows, args.bin)) if args.bin > 1 else rows
    return spans.required(spans.drop_uninformative(spans.compress(spans.validate(spans.recode_monomorphic(binned)))), "no contig has a derived allele")


def _states(data, args: argparse.Namespace, u: dict, start: float) -> list[float]:
    """Hidden states at the quantiles of the pair's meeting times as windows show them, each within a factor of 3 of those of
    a constant size; where rates do not differ, even shares of a constant size."""
    w = args.rate_window or max(1, round(2 / (u["theta"] * start)))  # a few mutations a window
    try:
        many = 2 * args.knots
        found = measures.meeting_quantiles(spans.mutation_rates(data, w), many, u["theta"], w)
        even = -start * np.log1p(-np.geomspace(0.01, 0.99, many))  # windows without a mutation say little: not far from a constant size
        states = [0.0, *np.unique(np.clip(found, even / 3, even * 3)).tolist(), np.inf]
    except ValueError:
        states = demography.Steps(np.zeros(1), np.array([start])).balanced(2 * args.knots)
    return states


SPLINES = (*splines.KINDS, "piecewise", "bspline")


def _curve(kind: str, knots: list[float], last: float):
    """Steps of the values at the knots, how many values there are, and their roughness."""
    fine = [0.0, *np.geomspace(max(knots[0], 1e-4) / 2, last, 24).tolist()]
    if kind == "bspline":
        make = lambda y: splines.basis(knots, y)
        return lambda y: demography.Steps(*map(np.array, splines.steps(make(y), fine))), len(knots) + 2, splines.control_roughness
    if kind == "piecewise":
        return lambda y: demography.Steps(np.array([0.0, *knots[1:]]), np.exp(y)), len(knots), demography.roughness
    return lambda y: demography.Steps(*map(np.array, splines.steps(splines.fit(kind, knots, y), fine))), len(knots), lambda y: splines.fit(kind, knots, y).roughness()


def _fit(spark, data, args: argparse.Namespace, penalty: float, folder: str | None = None) -> tuple:
    """A fit, written round by round to ``folder`` where there is one, and taken up from there."""
    data = spans.validate(spans.compress(data))
    u = models.units(args.mu, args.r)
    n = data.agg(F.max("nb1")).first()[0] or 0
    size = (spans.watterson(data).first()["theta"] or u["theta"]) / u["theta"]
    states = _states(data, args, u, size)
    knots = states[1:-1:2]
    curve, many, rough = _curve(args.spline, knots, states[-2] * 2)
    start, rho = None, u["rho"] * args.bin
    if folder:
        start = _resumed(spark, folder)
    learn = tuple(dict.fromkeys([*(["rho"] if args.r is None else []), *args.learn]))
    start = start or demography.Fit(np.full(many, np.log(size)), u["theta"] * args.bin, rho, [])

    def keep(message: str, state: dict) -> None:
        if folder and message in ("post M-step", "optimization finished"):
            fit = state["fit"]
            line = json.dumps({"round": len(fit.history), "y": fit.y.tolist(), "theta": fit.theta, "rho": fit.rho, "alpha": fit.alpha, "loglik": fit.history, "done": fit.done}, sort_keys=True)
            spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(folder)

    found, history = demography.estimate(_prepared(data, args, n), knots, states, u["theta"] * args.bin, rho, args.em_iterations, penalty, keep, None, start, learn, args.multi, curve, rough, conditioned.sample_parts, args.block_rows)
    return found, history, states, {**u, "theta": start.theta / args.bin, "alpha": start.alpha, "rho": start.rho / args.bin, "knots": knots, "values": start.y}


def _resumed(spark: SparkSession, folder: str):
    """The last round that was written, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rounds = [json.loads(r.value) for r in spark.read.text(folder).collect()]  # a line a round
    if not rounds:
        return None
    got = max(rounds, key=lambda r: (r["round"], r["done"]))
    return demography.Fit(np.array(got["y"]), got["theta"], got["rho"], got["loglik"], got["done"], got.get("alpha", 1.0))


BLOCKS = option("--block-rows", type=int, help="work on long contigs in blocks of so many rows, side by side")
FIT = (BLOCKS, option("--knots", type=int, default=8), option("--em-iterations", type=int, default=20), option("--bin", type=int, default=100, help="bases a bin"), option("--thinning", type=int), option("--rate-window", type=int), option("--spline", choices=SPLINES, default="piecewise"), option("--multi", action="store_true", help="move all knots together"), option("--learn", nargs="*", default=[], choices=tuple(demography.LEARNED), help="rates that are fitted too; the recombination rate always is where --r is not given"))


def _json(found: demography.Steps, history: list[float], states: list[float], u: dict, kind: str) -> str:
    model = {"class": "steps", "spline_class": kind, "N0": u["n0"], "knots": found.t.tolist(), "y": np.log(found.a).tolist(), "control": {"knots": list(u["knots"]), "y": list(map(float, u["values"]))}}
    return json.dumps({"theta": u["theta"], "rho": u["rho"], "alpha": u["alpha"], "hidden_states": [x if np.isfinite(x) else "inf" for x in states], "model": model, "loglik": history}, sort_keys=True)


@command(DATA, OUT, MU, RHO, *FIT, option("--penalty", type=float, default=0.0))
def estimate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Fit a model; writes one JSON line. Rounds are kept in ``out``-rounds, and a run that was ended goes on from the last."""
    found, history, states, u = _fit(spark, _rows(spark, args.spans), args, args.penalty, args.out + "-rounds")
    spark.createDataFrame([(_json(found, history, states, u, args.spline),)], "value string").coalesce(1).write.text(args.out)


@command(DATA, OUT, MU, RHO, *FIT, option("--folds", type=int, default=2), option("--penalties", type=float, nargs="+", default=[0.0, 1.0, 100.0]))
def cv(spark: SparkSession, args: argparse.Namespace) -> None:
    """Log likelihood of each left-out fold under each penalty, in ``out``/scores, and the best model of each fold in
    ``out``/best. Folds that are there already are not fitted again."""
    data = _rows(spark, args.spans)
    dealt = data.join(sampling.folds(data.select("contig_id").distinct(), args.folds), "contig_id")
    for fold in range(args.folds):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{args.out}/best/fold={fold}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            continue
        train, test = dealt.where(F.col("fold") != fold).drop("fold"), dealt.where(F.col("fold") == fold).drop("fold")
        tested = spans.compress(spans.validate(test))
        n = tested.agg(F.max("nb1")).first()[0] or 0
        tested = _prepared(tested, args, n)
        known = [tuple(r) for r in tested.select("a1", "b1", "nb1").distinct().collect()]
        scores = []
        for penalty in args.penalties:
            found, history, states, u = _fit(spark, train, args, penalty)
            model = conditioned.sample_model(found, states, u["theta"] * args.bin, u["rho"] * args.bin, known)
            loglik = float(hmm.logliks(tested, model, args.block_rows).agg(F.sum("loglik")).first()[0])
            scores.append((fold, float(penalty), loglik, _json(found, history, states, u, args.spline)))
        spark.createDataFrame([s[:3] for s in scores], "fold int, penalty double, loglik double").coalesce(1).write.mode("overwrite").parquet(f"{args.out}/scores/fold={fold}")
        best = max(scores, key=lambda s: (s[2], -s[1]))
        spark.createDataFrame([(best[1], best[2], best[3])], "penalty double, loglik double, model string").coalesce(1).write.mode("overwrite").parquet(f"{args.out}/best/fold={fold}")


#: How the model of a file is read, by its class.
CLASSES: dict[str, Callable[[dict], object]] = {
    "steps": lambda m: demography.Steps(np.array(m["knots"], float), np.exp(m["y"])),
    "two": lambda m: (CLASSES[m["model1"]["class"]](m["model1"]), CLASSES[m["model2"]["class"]](m["model2"]), float(m["split"])),
}


def _load(spark: SparkSession, path: str) -> tuple:
    """The model of a file (two models and their split, where it is of two populations), hidden states, and the file."""
    got = json.loads(spark.read.text(path).first()["value"])
    if got["model"].get("class") not in CLASSES:
        raise SystemExit(f"{path}: no model of a known class ({', '.join(CLASSES)})")
    return CLASSES[got["model"]["class"]](got["model"]), [float(x) for x in got["hidden_states"]], got


def _pair_of(data) -> tuple[int, int]:
    """Lineages of the pair in each population: a pair that is in one of two populations never shows an allele of it in the other."""
    most = data.agg(F.max("a1"), F.max("a2")).first()
    return (1, 1) if (most[1] or 0) > 0 else (2, 0)


@command(DATA, OUT, option("model1"), option("model2"), option("--pair", choices=("together", "apart"), help="default: as the rows show"), option("--second", help="Parquet of one-population rows of the second population"), option("--max-split", type=float, help="default: the last knot but one of the second model"), option("--polarization-error", type=float, default=0.5), option("--hold-sizes", action="store_true"))
def split_(spark: SparkSession, args: argparse.Namespace) -> None:
    """When two populations split, given a model of each; writes one JSON line with both models. Points of the profile are
    kept in ``out``-rounds."""
    (one, states, a), (two, _, b) = _load(spark, args.model1), _load(spark, args.model2)
    theta, rho = a["theta"], a["rho"]
    if not np.isclose(theta, b["theta"], rtol=1e-6):
        raise SystemExit("the two models were fitted with different mutation rates")
    data = _rows(spark, args.spans)
    if "a2" not in data.columns:
        raise SystemExit("these rows are of one population: they do not say when two split")
    kind = {"together": split.TOGETHER, "apart": split.APART, None: None}[args.pair] or _pair_of(data)
    sets = [split.counted(data, kind)]
    if args.second:
        sets.append(split.counted(spark.read.parquet(args.second), split.SECOND))
    most = args.max_split or float(two.t[-2] if len(two.t) > 2 else 2.0)
    found = split.fit(sets, one, two, theta, most, args.polarization_error, not args.hold_sizes)
    side = lambda got, model: {**got["model"], "knots": model.t.tolist(), "y": np.log(model.a * found.scale).tolist()}
    model = {"class": "two", "model1": side(a, one), "model2": side(b, two), "split": found.split}
    spark.createDataFrame(found.tried, "split double, scale double, loglik double").coalesce(1).write.mode("overwrite").parquet(args.out + "-rounds")
    line = json.dumps({"theta": theta, "rho": rho, "alpha": 1.0, "hidden_states": [x if np.isfinite(x) else "inf" for x in states], "model": model, "loglik": [found.loglik]}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(args.out)


@command(DATA, OUT, option("model"), BLOCKS)
def posterior(spark: SparkSession, args: argparse.Namespace) -> None:
    """State probabilities of every run under a fitted model, of one population or of two."""
    model, states, got = _load(spark, args.model)
    data = _rows(spark, args.spans)
    known = [tuple(r) for r in data.select(*hmm.key_columns(data)).distinct().collect()]
    alpha = got.get("alpha", 1.0)
    if "a2" in data.columns and isinstance(model, tuple):
        hidden = joint.model_of(*model, states, got["theta"], got["rho"], known, _pair_of(data), alpha=alpha)
    elif "a2" in data.columns or isinstance(model, tuple):
        raise SystemExit("rows of two populations need a model of two, as split writes it, and rows of one a model of one")
    else:
        hidden = conditioned.sample_model(model, states, got["theta"], got["rho"], known, alpha=alpha)
    hmm.posterior(data, hidden, args.block_rows).withColumn("hidden_states", F.array(*map(F.lit, states))).write.parquet(args.out)


@command(option("rates", help="table of time_index, left, right and rate of coalescence"), OUT, MU)
def rates(spark: SparkSession, args: argparse.Namespace) -> None:
    """A model, as the other commands read it, from a table of coalescence rates; times and sizes in units of N0."""
    u = models.units(args.mu)
    pieces = formats.coalescence_rates(spark, args.rates, "rates", args.mu).orderBy("t0").collect()  # a row a time interval
    if not pieces:
        raise SystemExit(f"no rates in {args.rates}")
    found = demography.Steps(np.array([r.t0 / (2 * u["n0"]) for r in pieces]), np.array([r["size"] / u["n0"] for r in pieces]))
    values = {"knots": found.t.tolist(), "values": np.log(found.a), "alpha": 1.0}
    spark.createDataFrame([(_json(found, [], found.balanced(32), {**u, **values}, "piecewise"),)], "value string").coalesce(1).write.text(args.out)


@command(option("models", nargs="+"), OUT, option("--generation", type=float, default=1.0, help="years a generation"))
def plot(spark: SparkSession, args: argparse.Namespace) -> None:
    """Curves of fitted models as CSV."""
    rows = []
    for i, path in enumerate(args.models):
        model, _, got = _load(spark, path)
        n0 = got["model"]["N0"]
        if isinstance(model, tuple):
            raise SystemExit("plot takes models of one population")
        rows += [(path, float(t * 2 * n0 * args.generation), float(a * n0), "step", i) for t, a in zip(model.t, model.a, strict=True)]
    formats.write_curves(spark.createDataFrame(rows, "label string, x double, y double, plot_type string, plot_num int"), args.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="spanlake")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        one = sub.add_parser(name, help=f.__doc__)
        for names, how in options:
            one.add_argument(*names, **how)
    args = parser.parse_args(argv)
    if getattr(args, "mu", None) is not None and not 1e-11 <= args.mu <= 1e-5:
        parser.error("mu is outside 1e-11 to 1e-5")
    for name, least in (("thinning", 1), ("bin", 1), ("knots", 2), ("em_iterations", 1), ("size", 1), ("draws", 1), ("folds", 2), ("block_rows", 2), ("rate_window", 1), ("length", 1), ("missing_cutoff", 1)):
        if getattr(args, name, None) is not None and getattr(args, name) < least:
            parser.error(f"--{name.replace('_', '-')} must be {least} or more")
    COMMANDS[args.command][0](spark or SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
