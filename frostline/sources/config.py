"""Configuration: Java-style properties with defaults, and overrides that win over the file."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields

from ..operators.anneal import Options

#: Fixed names of the file's keys, with the option each sets.
KEYS = {
    "MaxNcent": "max_clusters",
    "TooSmallToSplit": "too_small_to_split",
    "MinEigTest": "min_eigen_test",
    "ConvergeIntermediateClusters": "converge_intermediate",
    "WaitIterations": "wait_iterations",
    "EpsiMaxChange": "epsi_max_change",
    "InitialCoolingFactor": "initial_cooling",
    "FineCoolingFactor": "fine_cooling",
    "EigenValueChange": "eigenvalue_change",
    "EigenVectorChange": "eigenvector_change",
    "IterationAtEnd": "iteration_at_end",
    "ConvergenceLoopLimit": "loop_limit",
    "FreezingLimit": "freezing_limit",
    "PowerIterationLimit": "power_limit",
    "ContinuousClustering": "continuous",
}
#: Keys that are accepted and have no effect.
INERT = ("TransformDimension", "SplitOrExpandIt", "IsMemoryMapped", "DataTypeSize", "ProcessingOption", "ClusterNumberFile", "CenterPlotFile", "CenterPointsPerCenterTypeInOuput", "MPIIOStrategy")


@dataclass(frozen=True)
class Files:
    """The keys that are not options of the annealing: files, sizes and the center finder."""

    ClusterFile: str = "cluster.txt"
    DistanceMatrixFile: str = "distance.bin"
    AddMdsFile: str = "mds.txt"
    AddDapwcFile: str = "mds.txt"
    LabelFile: str = "labels.txt"
    TimingFile: str = "timings.txt"
    SummaryFile: str = "summary.txt"
    CenterOutputFile: str = ""
    NumberDataPoints: int = -1
    AddMds: int = 1
    BucketFractions: str = "0.15,0.4,0.75"
    NumberOfCenters: int = 8
    DebugPrintOption: int = 1
    ConsoleDebugOutput: bool = True
    IsBigEndian: bool = False
    Repetitions: int = 1


#: Fixed names and defaults of the tools' own sections.
EXTRACTOR = {"clusterFile": "cluster.txt", "distFile": "in.bin", "numPoints": -1, "outDir": "outfile.bin", "isBigEndian": False, "clusters": "None", "newclusters": "1", "runLine": "", "joins": ""}
COLLATE = {
    "pointsDir": "/home/", "pointFilePattern": "points.txt", "clustersDir": "/home/", "clusterDirpattern": "{0}", "clusterFilePattern": "clusters.txt", "outDir": "/home/", "outFilePattern": "out.txt", "outPlotFilePattern": "outplot.txt",
    "outLablesFilePattern": "outlabel.txt", "outsepereateFilesPattern": "sepereated.txt", "numClusters": 0, "join": "", "clusters": "",
}
BLOCK_MERGER = {"blockDir": "/home/blockDir", "nameFormat": "{1}-{2}.bin", "blockCount": 1, "outFile": "/home/outfile.bin", "skipRanks": "", "isBigEndian": False}


def section(text: str, defaults: dict[str, object], overrides: dict[str, str] | None = None) -> dict[str, object]:
    """A tool's settings: its defaults, the file's values, and overrides, in growing order of weight; unknown keys are named in a warning."""
    given = parse(text) | (overrides or {})
    for key in given.keys() - defaults.keys():
        warnings.warn(f"unknown key {key}", stacklevel=2)
    return {k: _as(type(v), given[k]) if k in given else v for k, v in defaults.items()}


def parse(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            key, _, value = line.replace(":", "=", 1).partition("=") if "=" not in line else line.partition("=")
            out[key.strip()] = value.strip()
    return out


def _as(kind: type, value: str):
    return value.lower() == "true" if kind is bool else kind(value)


def load(text: str, overrides: dict[str, str] | None = None) -> tuple[Options, Files]:
    """(annealing options, files and the rest) of a properties text; unknown and inert keys are named in a warning."""
    given = parse(text) | (overrides or {})
    options, files = {}, {}
    kinds = {f.name: type(getattr(Options(), f.name)) for f in fields(Options)}
    own = {f.name: type(getattr(Files(), f.name)) for f in fields(Files)}
    for key, value in given.items():
        if key in KEYS:
            options[KEYS[key]] = _as(kinds[KEYS[key]], value)
        elif key in own:
            files[key] = _as(own[key], value)
        else:
            warnings.warn(f"{key} has no effect" if key in INERT else f"unknown key {key}", stacklevel=2)
    return Options(**options), Files(**files)


def dump(values: dict[str, object]) -> str:
    """Properties text, as written for a derived run."""
    return "".join(f"{k} = {str(v).lower() if isinstance(v, bool) else v}\n" for k, v in values.items())
