"""Prompts for a summarising model, as columns, and the observation noise rules that they rest on."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldloom.functions import text as T

#: The part of a system prompt from here on is shared by all summarisers.
POLICY = "WHAT TO KEEP"
SYSTEM = f"""You write the long-term memory that takes the place of a stretch of an agent's history.
Use exactly these headers: {' '.join(T.HEADERS[:4])}

{POLICY}
- Keep whatever would be done again, fail again or be violated if it were forgotten: names, paths, line numbers,
  commands with their results, edits, failed attempts, constraints.
- Leave out what can be read again, what is repeated, and narration.
- Keep exit codes other than 0 and interrupts; leave out progress bars and shell footers.
- If in doubt, keep it."""


def with_policy(header: str, system: str = SYSTEM) -> str:
    """A new header over the shared policy; fails if the policy isn't there."""
    at = system.find(POLICY)
    if at < 0:
        raise ValueError(f"no {POLICY!r} in the prompt")
    return header.rstrip() + "\n\n" + system[at:]


SYSTEM_FORWARD = with_policy(f"You write a memory that looks back and ahead.\nUse exactly these headers: {' '.join(T.HEADERS)}\nName the next step as a plan; never quote commands or code that are still to come.")
SYSTEM_ROLLING = with_policy(f"You renew a rolling memory from the one before and the new steps.\nUse exactly these headers: {T.PINNED} {' '.join(T.HEADERS)}\nCarry {T.PINNED} on word for word and add lasting facts.")


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def slice_prompt(task: Column, lo: Column, hi: Column, slice_text: Column, budget: Column) -> Column:
    return _said("# Task\n", task, "\n\n# History to compress: steps ", lo, " to ", hi, "\n", slice_text, "\n\n# Length\nAbout ", budget, " tokens.\n\nReturn the memory alone.")


def forward_prompt(task: Column, lo: Column, hi: Column, slice_text: Column, continuation: Column, budget: Column) -> Column:
    return _said("# Task\n", task, "\n\n# History to compress: steps ", lo, " to ", hi, "\n", slice_text, "\n\n# What comes next, for orientation only\n", continuation, "\n\n# Length\nAbout ", budget, " tokens for the first four sections.\n\nReturn the seven sections alone.")


def rolling_prompt(task: Column, pinned: Column, before: Column, new_steps: Column, continuation: Column, budget: Column, task_chars: int = 12000, slice_chars: int = 48000) -> Column:
    return _said(
        "# Task\n", F.substring(task, 1, task_chars), "\n\n# Pinned facts so far\n", F.coalesce(F.nullif(pinned, F.lit("")), F.lit("None yet")), "\n\n# Memory so far\n",
        F.coalesce(F.nullif(before, F.lit("")), F.lit("None: this is the first.")), "\n\n# New steps\n", F.substring(new_steps, 1, slice_chars), "\n\n# What comes next, for orientation only\n", continuation,
        "\n\n# Length\nAbout ", budget, " tokens.\n\nReturn all sections.",
    )


def repair_prompt(task: Column, lo: Column, hi: Column, slice_text: Column, continuation: Column) -> Column:
    return _said("# Task\n", F.substring(task, 1, 8000), "\n\n# History that is compressed: steps ", lo, " to ", hi, "\n", F.substring(slice_text, 1, 48000), "\n\n# What follows\n", continuation,
        "\n\nThe memory before this lost facts that those steps need. Write all seven sections again with these facts, taken from the history; don't quote the steps that follow.")


TOO_LONG = "\n\nThe memory was too long. Write it again, shorter: leave out logs and listings, keep every fact."
TOO_SHORT = "\n\nThe memory was too short. Write it again with the paths, numbers, commands, edits, results and failures that it lost."
INCOMPLETE = "\n\nSections were missing. Write it again with every header, and None where a section is empty."

#: Lines of observations that say nothing (an exit code of 0 among them).
NOISE = (
    r"^\[Command finished with exit code 0\]$", r"^\[The command completed with exit code 0\.?\]$", r"^\[Python interpreter: .*\]$", r"^\[Current working directory: .*\]$",
    r"^\[ *[0-9]+%\]$", r"^\[GCC [0-9.]+.*\]$", r"^Your thought has been logged\.$", r"^Task list has been updated with [0-9]+ items\.$",
)


def without_noise(observation: Column) -> Column:
    """The observation without noise lines."""
    noise = lambda x: reduce(or_, (T.strip(x).rlike(p) for p in NOISE))
    return F.array_join(F.filter(T.lines(F.coalesce(observation, F.lit(""))), lambda x: ~noise(x)), "\n")
