"""Operators: functions from DataFrame to DataFrame, all keyed."""
