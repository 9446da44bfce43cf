"""From files to perturbed files in one run."""

from __future__ import annotations

import json
from decimal import Decimal

from ..errors import InputError
from ..progress import notify
from ..sources import exports
from ..sources.files import Place
from . import index, perturbation


def _mark(folder: Place, status: str, phase: str) -> None:
    """The run file is replaced only by a whole new one."""
    (folder / "run.json").replace_text(json.dumps({"status": status, "phase": phase}) + "\n")


def run_export(inputs, output_dir, *, strength=Decimal("0.16"), date_shift_days: int = 30, reuse_key_from=None, base_url: str | None = None, progress=None, spark=None) -> dict:
    """Index an export and perturb it: result/fhir has the files, result/reports the reports, intermediates all else.

    Everything is checked before the output folder is made; what fails later stays there to be looked at.
    """
    settings = perturbation.validate_settings(strength, date_shift_days)
    base_url = exports.normalize_base_url(base_url)
    notify(progress, "Looking for files")
    spark = spark or index.session()
    files, output = exports.discover(spark, inputs, output_dir)
    output.make_folder()
    work = (output / "intermediates").make_folder()
    phase = "ingestion"
    try:
        _mark(work, "in_progress", phase)
        found = index.write(spark, files, work, base_url, progress)
        if found["status"] not in index.DONE:
            raise InputError("The export has errors, which intermediates/report.json counts; mend them and run again into a new folder.")
        phase = "perturbation"
        _mark(work, "in_progress", phase)
        header = perturbation.run(spark, work, output, settings, reuse_key_from, reserved=True, progress=progress)
        phase = "complete"
        _mark(work, header["status"], phase)
        return header
    except BaseException as error:
        try:
            _mark(work, "interrupted" if isinstance(error, KeyboardInterrupt) else "failed", phase)
        except Exception:
            pass  # the earlier mark says it isn't whole, and the error itself matters more
        raise
