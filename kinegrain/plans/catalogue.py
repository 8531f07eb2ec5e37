"""Every registered query of the reference's own operators, with its SQL."""

from __future__ import annotations

from . import q_bodies, q_clouds, q_contact, q_datasets, q_eval, q_files, q_geometry, q_graph, q_objects, q_parts, q_relational, q_state, q_text, q_volumes
from .registry import ORACLE, QUERIES

FLAGSHIP = "eval_kinematic_report"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES", "q_bodies", "q_clouds", "q_contact", "q_datasets", "q_eval", "q_files", "q_geometry", "q_graph", "q_objects", "q_relational", "q_state", "q_text", "q_volumes"]
