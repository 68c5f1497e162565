"""A training corpus from raw documents: five stages, each one operator of surveyframe.llm (see surveyframe/llm/stages.py)."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from surveyframe.llm.stages import STAGES, run  # noqa: E402,F401

#: Random draws and searches by hash are not SQL; the tests compare the stages with brute force.
ORACLE_SQL = None
