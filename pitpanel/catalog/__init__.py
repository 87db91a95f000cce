"""Registered queries over the shared test tables, with their SQL equivalents."""

from pitpanel.catalog import entities, evaluation, features, forward, knowledge, membership

ALL = (knowledge.catalog, features.catalog, membership.catalog, entities.catalog,
       evaluation.catalog, forward.catalog)
