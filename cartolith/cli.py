"""Command line: ``python -m cartolith.cli [options] cube...``; exit code 0 for success, 1 if a cube failed, 2 for bad usage."""

from __future__ import annotations

import argparse
import sys
import threading

from . import __version__
from .plans.options import Options, OptionError
from .sources.isis import expand_inputs

FLAGS = {
    "raw": "keep stored numbers, without their scaling",
    "overviews": "add levels at half size",
    "interleave": "store samples by pixel",
    "approximate": "interpolate positions along rows, to an eighth of a pixel",
}
TEXTS = {
    "output": "file or folder", "type": "stored type", "stretch": "auto, minmax or LO,HI: to 8 bits", "nodata": "value, nan or none",
    "proj": "projection, as name:key=value,... or a PROJ string", "lat_type": "ocentric or ographic", "res": "resolution, or X,Y", "bounds": "W,S,E,N in degrees", "extent": "XMIN,YMIN,XMAX,YMAX", "size": "W,H", "resample": "nearest, bilinear or cubic",
    "overview_method": "average or nearest", "compress": "none, deflate or zstd", "bigtiff": "auto, yes or no", "predictor": "auto, none, 2 or 3",
}
NUMBERS = {"level": "compression level", "tile": "tile size, a multiple of 16", "threads": "tasks that make tiles", "cache": "megabytes of source blocks that a task keeps"}
#: Other names of options.
ALSO = {"output": ["-o", "--out"], "proj": ["-p", "--t_srs"], "type": ["-t"], "resample": ["-r"], "overview_method": ["--ov-resample"]}
PREDICTORS = {"auto": 0, "0": 0, "none": 1, "1": 1, "2": 2, "3": 3}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cartolith", allow_abbrev=False)
    p.add_argument("inputs", nargs="+")
    p.add_argument("--info", action="store_true", help="show what labels tell")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("-q", "--quiet", action="store_true", help="no reports, warnings or progress")
    p.add_argument("-b", "--bands", default="", help="band numbers from 1, comma-separated")
    p.add_argument("--normalize", action="store_true", help="to 0..1, or to the range of --type, with a label that tells the way back")
    p.add_argument("--exact", action="store_true", help="compute every position (the default; undoes --approximate)")
    default = Options()
    for group, more in ((FLAGS, {"action": "store_true"}), (TEXTS, {}), (NUMBERS, {"type": int})):
        for name, text in group.items():
            start = "auto" if name == "predictor" else getattr(default, name)
            p.add_argument(*ALSO.get(name, []), "--" + name.replace("_", "-"), dest=name, help=text, **({"default": start} | more))
    return p


def options_of(got: dict) -> Options:
    """Options of parsed arguments."""
    got = dict(got)
    bands, exact, normalize, predictor = got.pop("bands"), got.pop("exact"), got.pop("normalize"), got.pop("predictor").lower()
    if predictor not in PREDICTORS:
        raise OptionError("--predictor is auto, none, 2 or 3")
    if normalize:
        got |= {"normalize": got["type"] or "float32", "type": ""}
    if exact:
        got["approximate"] = False
    return Options(bands=tuple(int(b) for b in bands.split(",")) if bands else (), predictor=PREDICTORS[predictor], **got)


class Progress:
    """A line on a terminal that tells, five times a second, how many tasks of the running stages are done."""

    def __init__(self, spark, out=sys.stderr, every: float = 0.2, width: int = 30):
        self.tracker, self.out, self.every, self.width = spark.sparkContext.statusTracker(), out, every, width
        self.ended, self.thread = threading.Event(), threading.Thread(target=self._run, daemon=True)

    @staticmethod
    def bar(done: int, total: int, width: int) -> str:
        full = done * width // max(1, total)
        return f"[{'#' * full}{'.' * (width - full)}] {done} of {total}"

    def _run(self) -> None:
        while not self.ended.wait(self.every):
            stages = [s for s in map(self.tracker.getStageInfo, self.tracker.getActiveStageIds()) if s]
            if stages:
                print("\r" + self.bar(sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages), self.width), end="", file=self.out, flush=True)

    def __enter__(self):
        if self.out.isatty():
            self.thread.start()
        return self

    def __exit__(self, *_):
        self.ended.set()
        if self.thread.is_alive():
            self.thread.join()
            print(file=self.out)


def join_negative(args: list[str]) -> list[str]:
    """Values that begin with a minus and a digit go behind their option with an equals sign."""
    out: list[str] = []
    for a in args:
        if out and out[-1].startswith("--") and "=" not in out[-1] and len(a) > 1 and a[0] == "-" and (a[1].isdigit() or a[1] == "."):
            out[-1] += "=" + a
        else:
            out.append(a)
    return out


def main(args: list[str] | None = None, spark=None) -> int:
    try:
        got = vars(parser().parse_intermixed_args(join_negative(sys.argv[1:] if args is None else args)))
    except SystemExit as e:
        return 2 if e.code else 0
    inputs, info, quiet = got.pop("inputs"), got.pop("info"), got.pop("quiet")
    try:
        options = options_of(got)
        paths = expand_inputs(inputs)
    except (ValueError, OptionError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.builder.getOrCreate()
    if info:
        from .sources.isis import cube_info

        failed = 0
        for r in cube_info(spark, paths).orderBy("path").toLocalIterator():
            failed += r["samples"] is None
            print("\n".join(f"{k}: {v}" for k, v in r.asDict().items() if v is not None), end="\n\n")
        return int(failed > 0)
    from .plans.convert import convert

    tell = (lambda line: None) if quiet else (lambda line: print(line, file=sys.stderr))
    if quiet:
        written, failed = convert(spark, paths, options, tell)
    else:
        with Progress(spark):
            written, failed = convert(spark, paths, options, tell)
    for path in written:
        print(path)
    for path, why in failed.items():
        print(f"{path}: {why}", file=sys.stderr)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
