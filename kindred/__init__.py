"""Kindred: a Spark-native engine for finding, comparing and profiling similar entities.

Facts are kept in one long table, ``features(entity_id, component, param, value_num, value_str, unit, ptype)``: a row whose
two values are null is a known parameter without a value, a missing row is an unknown parameter.
"""
