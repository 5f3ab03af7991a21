"""Declared pipelines: workflows, chains and their builders."""
