"""Part of the tracewell engine: functions"""
