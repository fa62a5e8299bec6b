"""Delivery and technical-debt analytics as lazy DataFrame transformations."""
