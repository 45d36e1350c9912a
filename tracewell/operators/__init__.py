"""Part of the tracewell engine: operators"""
