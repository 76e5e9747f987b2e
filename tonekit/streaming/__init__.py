"""tonekit.streaming"""
