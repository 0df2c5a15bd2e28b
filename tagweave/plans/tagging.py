"""Build a golden corpus and tag records with it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.fixed_values import OOD_LABEL
from tagweave.functions.session import cut_lineage
from tagweave.operators.balls import BallIndex, bounded_nearest, fit_balls
from tagweave.operators.blocks import PackedCorpus, ScanLimits, pack
from tagweave.operators.clean import in_distribution, require_known_categories
from tagweave.operators.corpus import calibrate_ood, class_prototypes, stratify
from tagweave.operators.features import Artifacts, EncoderSpec, transform
from tagweave.operators.neighbours import CellIndex, fit_index, index_join, nearest
from tagweave.operators.scoring import (
    few_labels,
    pack_prototypes,
    with_blend,
    with_names,
    with_ood,
    with_prototype_scores,
    with_routing,
    with_vote,
)


@dataclass
class Corpus:
    """``golden(golden_id, label_id, embedding, ...)``, ``prototypes(label_id, proto)``,
    ``labels(label_id, category)`` and the OOD threshold (squared distance).
    """

    golden: DataFrame
    prototypes: DataFrame
    labels: DataFrame
    ood_threshold: float | None = None
    limits: ScanLimits = field(default_factory=ScanLimits)
    _packed: PackedCorpus | DataFrame | None = None
    _protos: PackedCorpus | DataFrame | None = None
    indexes: dict[str, CellIndex | BallIndex] = field(default_factory=dict)
    _index_options: dict[str, dict] = field(default_factory=dict)
    _few_labels: bool | None = None

    def index(self, kind: str, **options) -> CellIndex | BallIndex:
        """The kept index of a kind: ``ivf``, ``lsh`` or ``ball``.

        ``options`` go to the fit.  A kept index is not fitted again: other options than its own are an error.
        """
        if kind not in self.indexes:
            fit = fit_balls(self.golden, **options, limits=self.limits) if kind == "ball" else fit_index(self.golden, kind, **options)
            self.indexes[kind], self._index_options[kind] = fit, options
        elif options and options != self._index_options.get(kind):
            raise ValueError(f"the kept {kind} index was made with {self._index_options.get(kind)}, not {options}")
        return self.indexes[kind]

    def has_few_labels(self) -> bool:
        """Counted once, not for every batch of a stream."""
        if self._few_labels is None:
            self._few_labels = few_labels(self.labels)
        return self._few_labels

    def packed(self) -> PackedCorpus | DataFrame:
        """Golden vectors, broadcast once if small enough and reused by every query."""
        if self._packed is None:
            self._packed = pack(self.golden, self.limits)
        return self._packed

    def packed_prototypes(self) -> PackedCorpus | DataFrame:
        if self._protos is None:
            self._protos = pack_prototypes(self.prototypes, self.limits)
        return self._protos


@dataclass(frozen=True)
class BuildSpec:
    max_per_class: int = 500
    cap_method: str = "farthest"
    ood_percent: float = 95.0
    calibration_sample: int | None = 5000  # golden rows the OOD threshold is fitted on; None: all
    seed: int = 42


def build_corpus(
    golden: DataFrame,
    labels: DataFrame,
    ood: DataFrame | None = None,
    spec: BuildSpec = BuildSpec(),
    limits: ScanLimits = ScanLimits(),
) -> Corpus:
    """Cap the classes, average all rows per class, calibrate the threshold.

    ``golden`` and ``ood`` are encoded; prototypes use every golden row, the capped rows
    are written to the checkpoint folder because scoring and calibration share them.
    """
    prototypes = cut_lineage(class_prototypes(golden))
    capped = cut_lineage(stratify(golden, spec.max_per_class, spec.cap_method, spec.seed))
    corpus = Corpus(capped, prototypes, labels, limits=limits)
    corpus.ood_threshold = calibrate_ood(
        capped, ood, spec.ood_percent, spec.calibration_sample, spec.seed, corpus.packed(), limits
    )
    return corpus


def build_from_records(
    records: DataFrame,
    artifacts: Artifacts,
    ood_records: DataFrame | None = None,
    build: BuildSpec = BuildSpec(),
    encoder: EncoderSpec | None = None,
    ood_label: str = OOD_LABEL,
    limits: ScanLimits = ScanLimits(),
) -> Corpus:
    """From clean labelled records to a corpus; filters run before the encoder."""
    roles = artifacts.roles
    names = artifacts.labels.withColumnRenamed("category", roles.label)
    known = require_known_categories(in_distribution(records, roles.label, ood_label), names, roles.label)
    # Prototypes and the cap both read every vector: encode once, keep the table.
    golden = cut_lineage(transform(known, artifacts, encoder).withColumnRenamed(roles.id, "golden_id"))
    outside = None
    if ood_records is not None:
        chosen = ood_records.filter(F.col(roles.label) == ood_label)
        outside = transform(chosen, artifacts, encoder).withColumnRenamed(roles.id, "query_id")
    return build_corpus(golden, artifacts.labels, outside, build, limits)


def predict(
    queries: DataFrame,
    corpus: Corpus,
    k: int = 10,
    alpha: float = 0.6,
    confidence_threshold: float = 0.75,
    exclude_self: bool = False,
    index: str = "exact",
    metric: str = "l2",
    n_probe: int | None = None,
    where: Column | None = None,
    index_options: dict | None = None,
) -> DataFrame:
    """Tag encoded queries (``query_id``, ``embedding``, any other columns).

    With a corpus small enough to broadcast this is a projection: no shuffle, and it
    runs on a stream as it is.  ``index`` may be ``ivf``, ``lsh`` or ``ball`` for a large corpus: its cells are made once,
    with ``index_options``, and kept with the corpus.  ``n_probe`` is the search effort: cells, cells of each table, or leaves.  Without it ``ivf`` and
    ``lsh`` search with the effort fitted to a recall of 0.95 and ``ball`` until its answer is proved.  ``where`` chooses queries before they are searched; a
    filter on the result cannot move below the search, which runs once per row.
    """
    queries = queries if where is None else queries.filter(where)
    if index == "exact":
        near = nearest(queries, corpus.packed(), k, metric, exclude_self, corpus.limits)
    elif index in ("ivf", "lsh"):
        kept = corpus.index(index, **(index_options or {}))
        near = index_join(queries, kept, k, n_probe, metric, exclude_self, corpus.limits)
    elif index == "ball" and metric == "l2":
        kept = corpus.index("ball", **(index_options or {}))
        near = bounded_nearest(queries, kept, k, exclude_self, effort=n_probe, limits=corpus.limits).drop("rounds", "compared", "proved")
    else:
        raise ValueError("index must be 'exact', 'ivf', 'lsh' or, for metric 'l2', 'ball'")
    scored = with_prototype_scores(near, corpus.packed_prototypes(), corpus.limits)
    blended = with_blend(with_vote(scored), alpha)
    named = with_names(with_ood(blended, corpus.ood_threshold), corpus.labels, corpus.has_few_labels())
    return with_routing(named, confidence_threshold)
