"""tonekit.operators"""
