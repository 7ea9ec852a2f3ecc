"""Scans of note trees and office files, small config formats, and the tables that results are kept in."""
