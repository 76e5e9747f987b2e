"""tonekit.sources"""
