"""tonekit.functions"""
