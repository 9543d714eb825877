"""Feature chains as ``pyspark.ml`` stages, so that they stand in a Pipeline beside Spark's own and are saved with it.

A stage holds the configuration of one block or of several: the blocks of one stage are fitted in one pass over the
rows, those of later stages see what earlier ones added.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from strandmill.plans.blocks import FeatureChain, State


class _Configured(Params):
    """The configuration as JSON text, which is what gets saved: a stage acts alike before and after loading."""

    config = Param(Params._dummy(), "config", "JSON of {block key: parameters}", TypeConverters.toString)
    order = Param(Params._dummy(), "order", "block keys in the order they are applied; empty: as configured", TypeConverters.toListString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(config="{}", order=[])

    def chain(self) -> FeatureChain:
        return FeatureChain(json.loads(self.getOrDefault("config")), self.getOrDefault("order") or None)


def _text(config: Mapping[str, Mapping | None]) -> str:
    """JSON of a configuration that JSON can hold without loss: keys of mappings are text, values plain."""
    def check(value, at: str) -> None:
        if isinstance(value, Mapping):
            for k, v in value.items():
                if not isinstance(k, str):
                    raise ValueError(f"{at}: the key {k!r} is not text")
                check(v, f"{at}.{k}")
        elif isinstance(value, (list, tuple)):
            for v in value:
                check(v, at)
        elif value is not None and not isinstance(value, (str, bool, int, float)):
            raise ValueError(f"{at}: {type(value).__name__} cannot be saved")

    check(config, "config")
    return json.dumps(config)


class FeatureBlocks(_Configured, Estimator, MLReadable, MLWritable):
    """Fits the blocks of ``config``; errors in it are raised here, not at the fit.

    Blocks without a fit need no rows and pass the fit through.  An empty table fits like any other: what a block
    does without statistics is its own rule.
    """

    def __init__(self, config: Mapping[str, Mapping | None] | None = None, order: Sequence[str] = ()) -> None:
        super().__init__()
        if config is not None:
            self._set(config=_text(config), order=list(order))
            self.chain()

    def _fit(self, dataset: DataFrame) -> FeatureBlocksModel:
        return self._copyValues(FeatureBlocksModel(self.chain().fit(dataset)))

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class FeatureBlocksModel(_Configured, Model, MLReadable, MLWritable):
    """Applies fitted blocks; its state is tables, saved as Parquet beside the parameters."""

    def __init__(self, state: Mapping[str, State] | None = None) -> None:
        super().__init__()
        self.state = dict(state or {})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.chain().transform(dataset, self.state)

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


class _StateWriter(MLWriter):
    def __init__(self, model: FeatureBlocksModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        """State first: a folder that holds parameters holds all the state they name."""
        FeatureChain.save(self.model.state, f"{path}/state")
        names = {key: sorted(tables) for key, tables in self.model.state.items()}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"state": names})


class _StateReader(MLReader):
    def __init__(self, cls: type[FeatureBlocksModel]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FeatureBlocksModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(FeatureChain.load(self.sparkSession, f"{path}/state", metadata["state"]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
